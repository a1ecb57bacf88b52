"""Queries against plain Python on the small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from ledgerloom.llm import packing, simhash
from ledgerloom.llm.licenses import BASE_PHRASES
from ledgerloom.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(name, same_rows):
    same_rows(QUERIES[name], ORACLE_SQL[name])


def test_license_scan(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op1_license_scan"](spark, sf_dir).collect()}
    for d in rows(spark, sf_dir, "documents"):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (d["text"] or "").translate(LOWER))
        at = [(i, label) for label, phrase in BASE_PHRASES for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
        r = got[d["doc_id"]]
        assert r["n_words"] == len(words) and r["n_base"] == len(at)
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == (r["labels"] != "")


def test_license_templates_against_brute_force(spark, sf_dir):
    import math

    from ledgerloom.llm import licenses

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    full = "Copyright 2020\n" + " ".join(w for w in dict(licenses.NOTICES)["zlib"].replace("[[", "").replace("]]", "").split()) + " end"
    partly = "software distributed under the License is distributed on an AS IS basis, without any warranties"
    planted = [(-1, full), (-2, partly), (-3, "Released under the MIT License. Licensed under CC BY SA 4.0 or the mit license"), (-4, None)]
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    words = {r["doc_id"]: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(LOWER)) for r in docs.collect()}
    held = Counter(w for ws in words.values() for w in set(ws))
    idf = lambda w: math.log((2 + len(words)) / (1 + held[w]))
    templates = [(label, True, f"[[{text}]]") for label, text in licenses.BASE_PHRASES] + [(label, False, text) for label, text in licenses.NOTICES]
    want = {}
    for i, ws in words.items():
        want[i] = []
        for label, base, text in templates:
            before, key, after = (x.split() for x in re.split(r"\[\[|\]\]", text))
            body = before + key + after
            for at in (k for k in range(len(ws)) if ws[k : k + len(key)] == key):
                place = [(w, at - len(before) + q) for q, w in enumerate(body)]
                hit = sum(idf(w) for w, q in place if 0 <= q < len(ws) and ws[q] == w)
                want[i].append((label, base, at, round(hit / sum(map(idf, body)), 9)))
    got = {r["doc_id"]: [(m["label"], m["base"], m["start"], round(m["score"], 9)) for m in r["matches"]] for r in licenses.find_licenses(docs).collect()}
    assert got == {i: sorted(m) for i, m in want.items()}
    assert [m[0] for m in got[-1]] == ["zlib"] and got[-1][0][3] == 1 and got[-2][0][0] == "apache" and 0 < got[-2][0][3] < 1
    assert {m[0] for m in got[-3]} == {"mit", "cc-by", "cc-by-sa"}
    index = licenses.fitted_index(docs)
    for k, (_, _, body, keys) in enumerate(index.templates):
        rarest = max(index.idf[body[p]] for p in keys)
        assert [p for w, found in index.postings.items() for t, p in found if t == k and index.idf[w] == rarest]


def slow_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, c in ones.items() if 2 * c > len(grams))


def test_simhash_near_dedup(spark, sf_dir):
    docs = rows(spark, sf_dir, "documents")
    prints = {d["doc_id"]: slow_fingerprint(d["text"]) for d in docs}
    parent = {i: i for i in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op3_simhash_near_dedup"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_sequence_packing(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op6_sequence_packing"](spark, sf_dir).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for d in rows(spark, sf_dir, "documents"):
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by_doc.pop(d["doc_id"]), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not by_doc
    used = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        used += at
    assert used / (2048 * len(by_sequence)) > 0.97


def test_encoder_equals_the_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder("byte_bpe_50k")
    points = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i : i + 64]) for i in range(0, len(points), 64)]
    texts += ["", " ", "a<|endoftext|>b", "x" * 5000, " \n\n  \t a1 b's I'LL 12 345 ", "\u00a0\u2028\u0085 e\u0301", "a" + " " * 400 + "b"]
    for t in texts:
        assert enc.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:40])


def test_html_text(spark, sf_dir):
    import html

    pages = {r["page_id"]: r for r in rows(spark, sf_dir, "pages")}
    got = QUERIES["op10_html_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]]["html"]).group(1)
        blocks = [re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", body)]
        want = "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)
        assert r["text"] == want and r["n_chars"] == len(want)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    noise = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) if k else 0 for k in rng.integers(0, 4, 400)], np.uint64)
    fps = np.unique(np.concatenate([base, base[rng.integers(0, 40, 400)] ^ noise]))

    def groups(pairs, n):
        label = np.arange(n)
        for u, v in pairs:
            label[label == label[u]] = label[v]
        return {frozenset(np.flatnonzero(label == x).tolist()) for x in label}

    n = len(fps)
    want = groups([(i, j) for i in range(n) for j in range(i) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 4], n)
    assert groups(zip(*simhash.tile_forest(fps, None, 4)), n) == want
    cut = n // 3
    pairs = [p for s in (slice(0, cut), slice(cut, n)) for p in zip(*(x + s.start for x in simhash.tile_forest(fps[s], None, 4)))]
    pairs += list(zip(*simhash.tile_forest(fps[:cut], fps[cut:], 4)))
    assert groups(pairs, n) == want


def test_chat_readback_survives_control_strings(spark):
    from ledgerloom.llm import chat

    texts = ["</s>", "<\\/s>", "[INST]x[/INST]", "[SEP]", "<\\\\s>", "\\<s>", "[\\INST]", "", "a\\b", "$1"]
    turns = [(1, k, role, t) for k, (t, role) in enumerate((t, r) for t in texts for r in ("user", "user", "assistant", "[SEP]"))]
    df = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    r = df.select("formatted", "segments", chat.parse_turns("formatted").alias("turns")).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, t) for _, _, role, t in turns]
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert sum(s["loss"] for s in r["segments"]) == len(texts)


def test_pipeline_against_brute_force(spark, sf_dir):
    import corpus_pipeline
    from ledgerloom.llm.common import alnum_words

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, spark.createDataFrame(stage(spark, docs, sf_dir).toPandas())
        out[name] = (before.collect(), docs.collect())
    good, kept = out["quality rules"]
    verdict = {r["doc_id"] for r in QUERIES["op7_quality_rules"](spark, sf_dir).where("kept").collect()}
    assert {r["doc_id"] for r in kept} == verdict < {r["doc_id"] for r in good}
    before, after = out["line dedup"]
    sites, first = defaultdict(set), {}
    norm = lambda x: " ".join(x.lower().split())
    for r in before:
        for line in r["text"].split("\n"):
            sites[norm(line)].add(r["source"])
            first[norm(line)] = min(first.get(norm(line), r["doc_id"]), r["doc_id"])
    texts = {
        r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if not norm(x) or len(sites[norm(x)]) < 3 or first[norm(x)] == r["doc_id"])
        for r in before
    }
    same = {r["doc_id"]: r["text"] for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == {i: t for i, t in texts.items() if t.strip() or t == same[i]}
    assert all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = out["SimHash near-dedup"]
    shingles = {}
    for r in before:
        w = r["text"].translate(LOWER).split()
        shingles[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    stay = {r["doc_id"] for r in after}
    group = {i: i for i in shingles}
    for i in shingles:
        for j in shingles:
            if i < j and len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                group = {k: group[i] if g == group[j] else g for k, g in group.items()}
    want = {min(k for k in group if group[k] == g) for g in group.values()}
    assert stay >= want and len(stay - want) <= 0.03 * (len(group) - len(want)) + 1
    before, after = out["benchmark decontamination"]
    windows = set()
    for r in rows(spark, sf_dir, "benchmark"):
        w = alnum_words(r["text"].encode())
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}
    sizes = {len(x) for x in windows}

    def dirty(text):
        w = alnum_words(text.encode())
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not dirty(r["text"])}
    before, after = out["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert sum(r["length"] for r in after) == sum({r["doc_id"]: r["doc_tokens"] for r in after}.values())


def test_sha_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
