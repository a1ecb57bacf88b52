"""Token counts, fill-in-middle and conversation repair against plain versions."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fim, repair, tokencount

TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ODD = [None, "", " ", "\n", "a", " a", "a ", "  a  b ", "\n\n x\n", "▁x ▁", "a▁b", "<s> [INST]", "ﬁ é　x", "a\x00b\r\n\tc", "x" * 3000, "𝔘 𝔘𝔘  \n", "<P>", "no <S> here", "tail \n "]
LONG = " ".join(f"w{i % 977}x{i % 1013}" for i in range(300_000))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate([*ODD, LONG, "z" * 200_000, "\n".join(["same line"] * 9000)])]
    return spark.createDataFrame([*rows, rows[4], rows[4], (None, "null id", None, None)], "doc_id long, text string, n string, lengths string")


# --- token counts


def test_token_counts_equal_the_model(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = tokencount.count_tokens(docs, limit=50).collect()
    rows = docs.collect()
    want = tokencount.whole_counts(r["text"] for r in rows)
    plain = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), n, n > 50) for r, n in zip(rows, want))
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == plain


def test_token_counts_do_not_depend_on_the_table(odd):
    tables = [tokencount.FrequentTable.of([], []), tokencount.frequent_table(odd, size=3), tokencount.frequent_table(odd)]
    assert len(tables[1].lookup()) <= 3 and " same" not in tables[0].lookup() and tables[2].lookup()["\nsame"] == 2
    counts = [sorted(map(repr, tokencount.count_tokens(odd, frequent=t).collect())) for t in tables]
    assert counts[0] == counts[1] == counts[2]


def test_token_counts_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokencount.count_tokens(empty).count() == 0


def test_frequent_summary_keeps_what_must_stay():
    from collections import Counter

    random.seed(3)
    stream = [f"t{min(int(random.expovariate(0.05)), 400)}" for _ in range(20_000)]
    held = Counter()
    for t in stream:
        held[t] += 1
        if len(held) > 120:
            held = tokencount.pruned(held, 40)
    held = tokencount.pruned(held, 40)
    assert {t for t, n in Counter(stream).items() if n > len(stream) / 40} <= set(held) and len(held) <= 40


def test_worker_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_SIZE", 100)
    known = tokencount.counter("piece_bpe_32k.model")
    text = " ".join(f"q{k}z" for k in range(1000))
    n = sum(known.count(t, {}) for _ in range(2) for t in tokencount.pre_tokens(text)) // 2
    assert n == tokencount.whole_counts([text])[0] and len(known.cache) <= 1100


def test_stretches_of_long_texts(monkeypatch):
    monkeypatch.setattr(tokencount, "STRETCH", 7)
    for text in [t for t in ODD if t] + ["a  b   c    d     e      f\n\n \n  g" * 5]:
        joined = [t for ts in tokencount.pre_tokens(text) for t in ts]
        assert joined == re.findall(r" +[^ \n]*|\n[^ \n]*", " " + text.replace("▁", " "))


# --- fill-in-middle


def plain_fim(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    tokens = re.findall(TOKEN, text)
    n, digest = len(tokens), sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("rate", [50, 100])
def test_fill_in_middle_against_plain_version(odd, rate):
    made = fim.fill_in_middle(odd, rate=rate).withColumn("back", fim.restored()).collect()
    want = sorted((repr((r["doc_id"], *plain_fim(r["doc_id"], r["text"], rate=rate))) for r in odd.collect()))
    assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])) for r in made) == want
    source = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert all(r["back"] == source[r["doc_id"]] for r in made)
    assert rate == 50 or {r["form"] for r in made} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("kind", ["array", "bitmap", "runs", "mixed"])
def test_boundary_set_select(kind):
    rng = np.random.default_rng(5)
    spans = {
        "array": [np.sort(rng.choice(fim.SPAN, 500, False))],
        "bitmap": [np.flatnonzero(rng.random(fim.SPAN) < 0.4)],
        "runs": [np.r_[10:9000, 20000:40000]],
        "mixed": [np.r_[0:60000], np.array([], np.int64), np.array([3, 65535]), np.flatnonzero(rng.random(fim.SPAN) < 0.3)],
    }[kind]
    found = fim.BoundarySet((k * fim.SPAN, low) for k, low in enumerate(spans))
    plain = np.concatenate([k * fim.SPAN + low for k, low in enumerate(spans)])
    names = {"array": fim.ArrayContainer, "bitmap": fim.BitmapContainer, "runs": fim.RunContainer}
    assert len(found) == len(plain) and (kind == "mixed" or isinstance(found.containers[0], names[kind]))
    for k in {0, len(plain) - 1, *rng.integers(0, len(plain), 300).tolist()}:
        assert found.select(k) == plain[k]


@pytest.mark.parametrize("n", [fim.SPAN - 1, fim.SPAN, fim.SPAN + 1, 2 * fim.SPAN])
def test_token_ends_at_span_borders(n):
    random.seed(n)
    text = "".join(random.choice("ab \n𝔘") for _ in range(n))
    for t in (text, text[:-2] + "a ", text[:-1] + "b", text[: fim.SPAN - 1] + " a" + text[fim.SPAN + 1 :]):
        ends = [int(base + x) for base, low in fim.token_ends(t) for x in low]
        assert ends == list(itertools.accumulate(map(len, re.findall(TOKEN, t))))


def test_fill_in_middle_of_an_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- conversation repair

COST = {"K": 0, "R": 1, "D": 2, "I": 5}


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def slow_repair(rows):
    """Cheapest edits by trying all of them (short) or by search over (row, pattern) with whole strings."""
    faults = faults_of(rows)
    moves = {"": "su", "s": "u", "u": "a", "a": "u"}
    best, heap = {}, [(0, 0, "", "", ())]
    # every way to a place with its cost and whole edit string; only the least is followed on
    while heap:
        k, cost, audit, last, made = heapq.heappop(heap)
        ways = best.setdefault((k, last), [])
        if any((c, a) <= (cost, audit) for c, a, _ in ways):
            continue
        ways.append((cost, audit, made))
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in moves[last]:
                if len(audit) - len(audit.rstrip("I")) < 3:
                    heapq.heappush(heap, (k, cost + 5, audit + "I", r, (*made, (name, ""))))
                if k < len(rows) and faults[k] not in "bd":
                    heapq.heappush(heap, (k + 1, cost + 1 + 5 * (faults[k] == "t"), audit + "R", r, (*made, (name, rows[k][1]))))
        if k < len(rows):
            heapq.heappush(heap, (k + 1, cost + 2, audit + "D", last, made))
            if faults[k] not in "bd" and rows[k][0][:1] and rows[k][0][0] in moves[last]:
                heapq.heappush(heap, (k + 1, cost + 5 * (faults[k] == "t"), audit + "K", rows[k][0][0], (*made, rows[k])))
    cost, audit, made = min(x for last in ("", "a") for x in best.get((len(rows), last), []))
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in made)


def all_edits(rows):
    """(cost, edits) of the least of all edit strings, by trying each; a few rows only."""
    faults, found = faults_of(rows), []
    for ways in itertools.product(["D", "K", "R", "ID", "IK", "IR", "IID", "IIK", "IIR"], repeat=len(rows)):
        for tail in ("", "I", "II"):
            audit, pattern, k, cost = "".join(ways) + tail, "", 0, 0
            for e in audit:
                role = "u" if pattern[-1:] in ("", "s", "a") else "a"
                pattern += "" if e == "D" else (rows[k][0][:1] or "?") if e == "K" else role
                cost += COST[e]
                if e != "I":
                    cost += 5 * (faults[k] == "t" and e != "D") + (1000 if faults[k] in "bd" and e != "D" else 0)
                    k += 1
            if re.fullmatch("(s?(ua)+)?", pattern):
                found.append((cost, audit))
    return min(found)


def random_rows(n):
    roles = ["user", "assistant", "system", "tool", "", "umpire"]
    texts = ["One.", "Two!", "no end", " ", "", "Three?\n", "more"]
    return [(random.choice(roles[: random.choice((3, 6))]), random.choice(texts) + random.choice(["", " x.", " y"]) * (random.random() < 0.5)) for _ in range(n)]


def report(spark, talks, size=None):
    rows = [(k, t, r, x) for k, talk in talks.items() for t, (r, x) in enumerate(talk)]
    random.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in repair.repair_report(repair.repair_conversations(turns)).collect()}


def test_slow_repair_tries_all():
    random.seed(1)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = random_rows(n)
            assert slow_repair(rows)[:2] == all_edits(rows)


def test_repair_against_plain_version(spark):
    random.seed(2)
    talks = {k: random_rows(random.choice((1, 2, 3, 5, 8, 13))) for k in range(250)}
    got = report(spark, talks)
    assert set(got) == set(talks)
    for k, rows in talks.items():
        cost, audit, text = slow_repair(rows)
        r, faults = got[k], faults_of(rows)
        initials = [role[:1] for role, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, sha(text)), rows
        assert (r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["gaps"]) == (*map(faults.count, "bdt"), illegal, 0)


def test_long_conversation_over_many_segments(spark, monkeypatch):
    random.seed(4)
    talk = random_rows(700) + [("user", f"q{k}.") for k in range(40)] + random_rows(300)
    whole = report(spark, {7: talk, 8: random_rows(5)})[7]
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 16)
    monkeypatch.setattr(repair, "SEGMENT_CHARS", 60)
    cut = report(spark, {7: talk})[7]
    cost, audit, text = slow_repair(talk)
    assert cut == whole and (cut["cost"], cut["audit"], cut["repaired_sha256"]) == (cost, audit, sha(text))


def test_repair_is_linear_in_a_segment():
    kinds = np.random.default_rng(1).integers(0, 12, 200_000)
    edits = repair.edits_of(kinds, 0, None, True)
    assert len(edits) == len(kinds) and set("".join(edits)) <= set("KRDI")


def test_repair_of_nulls_ties_and_repeats(spark):
    rows = [(None, None, None, None), (None, 2, "user", "a."), (None, 2, "user", "a."), (1, 5, "user", "q."), (1, 5, "assistant", "b."), (1, None, "system", "s."), (2, None, "user", None)]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r["conv_id"]: r for r in repair.repair_report(repair.repair_conversations(turns)).collect()}
    for key in (None, 1, 2):
        mine = sorted(((r[1] is not None, r[1], r[2] or " ", r[3] or " ") for r in rows if r[0] == key), key=lambda x: (x[0], x[1] or 0, *x[2:]))
        cost, audit, text = slow_repair([x[2:] for x in mine])
        assert (got[key]["cost"], got[key]["audit"], got[key]["repaired_sha256"], got[key]["gaps"]) == (cost, audit, sha(text), 0)
    assert repair.repair_report(repair.repair_conversations(turns.where("false"))).count() == 0


def test_same_row_many_times_is_dealt_out(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    edited = repair.repair_conversations(turns)
    assert edited.select("part").distinct().count() > 1
    r = repair.repair_report(edited).first()
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (2999, 2999, *slow_repair([("user", "Hi.")] * 3000)[:2])


def test_damage_and_turns_one_by_one(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    hurt = {}
    for r in turns.collect():
        draw = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if draw == 1 else re.sub("[.!?]", "", r["text"]) if draw == 2 else r["text"]
        hurt.setdefault(r["conv_id"], []).extend([(r["turn"], "user" if draw == 4 else r["role"], text)] * (0 if draw == 0 else 2 if draw == 3 else 1))
    edited = repair.repair_conversations(repair.damaged(turns))
    got = {}
    for r in sorted(repair.repaired_turns(edited).collect(), key=lambda r: (r["conv_id"], r["part"], r["seg"], r["position"])):
        got.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for k, rows in hurt.items():
        assert "\n".join(got.get(k, [])) == slow_repair([x[1:] for x in sorted(rows, key=lambda x: x[0])])[2]
