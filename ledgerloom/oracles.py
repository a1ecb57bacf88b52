"""DuckDB SQL of the queries, written apart from their Spark plans."""

from __future__ import annotations

from .constants import BACKGROUND, CONFUSED, CORRUPTION, EPS, FAMILIES, GENERIC, LABELS, MCC, PATTERNS, PERIODS, PREFIX_NOISE, SUFFIX_NOISE, SUFFIXES, TEMPLATES, TEST_CUTOFF, TEST_WINDOWS
from .operators.noise import merchant_codes
from .sources.ledger import CODES, VOCABULARY


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def per_family(f) -> str:
    return ", ".join(f(x) for x in FAMILIES)


NORM = "trim(regexp_replace(replace(replace(replace(replace(lower({0}), 'dgtl', 'digital'), 'mth', 'monthly'), 'prem ', 'premium '), 'insur ', 'insurance '), '[^a-z]+', ' ', 'g'))"
GAP_KEYS = "client_id, currency, group_type, comp"
FAMILY_DIM = ", ".join(
    f"({k}, '{f}', '{MCC[f]}', '{PATTERNS[f]}', [{texts(TEMPLATES[f])}])" for k, f in enumerate(FAMILIES)
)
LABEL_DIM = ", ".join(f"({k}, '{x}')" for k, x in enumerate(LABELS))
TEMPLATE_DIM = ", ".join(f"('{f}', '{t}')" for f, ts in TEMPLATES.items() for t in ts)
CODE = "CASE family " + " ".join(f"WHEN '{f}' THEN '{c}'" for f, c in MCC.items()) + " END"
PER_FAMILY_SQL = ",\n".join(
    f"avg(regexp_matches(txt, '{PATTERNS[f]}')::INT) AS semantic_{f}, avg((mcc = '{MCC[f]}')::INT) AS mcc_{f}, "
    f"count(DISTINCT CASE WHEN txt IN ({texts(TEMPLATES[f])}) THEN txt END) AS template_{f}_diversity, count(*) FILTER (WHERE txt IN ({texts(TEMPLATES[f])})) AS template_{f}_count"
    for f in FAMILIES
)
SCORES = ", ".join(f"semantic_{f} + 0.25 * mcc_{f}" for f in FAMILIES)

NUMBER = "substr(client_id, 2)::BIGINT"
TEMPLATE_STATS = [f"{s}_{w}_{c}" for s in ("any", "mcc") for w in (999, 90) for c in ("diversity", "repeated", "sum", "max", "rank0", "rank1", "rank2", "rank3")]
COMPACT = "count amount_mean amount_median amount_cv amount_mad amount_change first_age last_age span gap_median gap_mean gap_std gap_mad gap_cv gap_last gap_recent next_median next_recent linear_period linear_residual linear_next overdue_ratio own_semantic own_mcc own_template_diversity own_template_count other_semantic description_top_fraction generic_fraction".split()
COMPACT += [*(f"count_{w}" for w in TEST_WINDOWS), "price_support", "normalized_price"]
SLOTS = {"amount0": ("amount", 0), "amount1": ("amount", 1), "broad0": ("broad", 0), "broad1": ("broad", 1)}


def at_slot(slot: str, c: str) -> str:
    kind, rank = SLOTS[slot]
    return f"max(CASE WHEN kind = '{kind}' AND rank = {rank} THEN {c} END) AS {slot}_{c}"


def mod(x: str, p: str) -> str:
    return f"((({x}) % {p}) + {p}) % {p}"


def of_family(prefix: str) -> str:
    return "CASE candidate " + " ".join(f"WHEN '{f}' THEN {prefix.format(f)}" for f in FAMILIES) + " END"


def support(a: str) -> str:
    return f"exp(-8 * greatest(0, ln(low / greatest({a}, 0.01)), ln(greatest({a}, 0.01) / high)))"


def drawn(key: str, salt: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {key}, {salt})), 1, 8))::BIGINT"


def chosen(values: list[str], key: str, salt: int) -> str:
    return f"[{texts(values)}][({drawn(key, salt)} % {len(values)} + 1)::INT]"


def label_at(step: int) -> str:
    return f"[{texts(LABELS)}][({NUMBER} * {step} % 8 + 1)::INT]"


def clocks(top: str) -> str:
    """Clock columns of the four slots for streams ``top``, per candidate."""
    columns = ["count", "gap_median", "last_age", "next_median", *(f"{k}_{j}" for j in range(len(PERIODS)) for k in ("ps", "pn"))]
    wide = ", ".join(at_slot(s, c) for s in SLOTS for c in columns)
    fits = lambda s: "[" + ", ".join(f"{{'f': (1 - {s}_ps_{j}) + 0.8 * abs(ln(greatest({s}_gap_median, 1) / {float(p)})), 'k': {j}, 'p': {float(p)}::DOUBLE, 'n': {s}_pn_{j}, 's': {s}_ps_{j}}}" for j, p in enumerate(PERIODS)) + "]"
    best = ", ".join(f"list_sort({fits(s)})[1] AS {s}_b, coalesce({s}_gap_median > 0 AND {s}_count >= 3, false) AS {s}_v" for s in SLOTS)
    made = ", ".join(
        f"CASE WHEN {s}_v THEN {s}_b.p END AS {s}_clock_period, CASE WHEN {s}_v THEN {s}_b.n ELSE 999 END AS {s}_clock_next, "
        f"CASE WHEN {s}_v AND coalesce({s}_last_age < {s}_b.p * 1.4, false) THEN {s}_b.n ELSE 999 END AS {s}_clock_active_next, CASE WHEN {s}_v THEN {s}_b.s ELSE 0 END AS {s}_clock_strength, "
        f"({s}_v AND coalesce({s}_last_age < {s}_b.p * 1.4, false))::BIGINT AS {s}_clock_active, CASE WHEN {s}_v THEN {mod(f'{s}_next_median', f'{s}_b.p')} ELSE 999 END AS {s}_next_modulo"
        for s in SLOTS
    )
    return f"""SELECT client_id, family, {made}, {', '.join(f'{s}_last_age' for s in SLOTS)} FROM (SELECT *, {best} FROM cand LEFT JOIN
        (SELECT client_id, candidate AS family, {wide} FROM {top} JOIN ph USING (client_id, currency, group_type, comp) GROUP BY client_id, candidate) USING (client_id, family))"""


def compared(c: str) -> str:
    w = "OVER (PARTITION BY client_id)"
    return (
        f"min({c}) {w} AS {c}_competition_min, max({c}) {w} AS {c}_competition_max, avg({c}) {w} AS {c}_competition_mean, "
        f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY client_id ORDER BY {c} NULLS LAST) END AS {c}_competition_rank, {c} - min({c}) {w} AS {c}_competition_delta"
    )


#: Common table expressions in the order of their dependence.
CTES = {
    "b0": "SELECT event_id, user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events",
    "b1": "SELECT *, CAST((user_id * 3 + k) % 30 AS INT) + 1 AS di FROM b0",
    "b2": f"""SELECT event_id AS tx_id, concat('C', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS client_id, ts AS timestamp, value AS amount,
        CASE WHEN user_id % 3 = 0 THEN 'eur' ELSE 'chf' END AS currency,
        CASE event_type WHEN 'error' THEN 'refund' WHEN 'signup' THEN 'topup' ELSE 'card_payment' END AS type,
        CASE WHEN event_type IN ('error', 'signup') THEN 'in' ELSE 'out' END AS direction,
        CASE WHEN event_id % 11 = 0 THEN '5812' ELSE split_part('{CODES}', '|', di) END AS mcc,
        concat(CASE WHEN k % 5 = 0 THEN 'PAY ' ELSE '' END, CASE WHEN event_id % 3 = 0 THEN upper(split_part('{VOCABULARY}', '|', di)) ELSE split_part('{VOCABULARY}', '|', di) END,
          CASE WHEN k % 4 = 0 THEN concat(' #', CAST(k AS VARCHAR)) WHEN k % 4 = 1 THEN ' online' ELSE '' END) AS description,
        CAST(CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS fee FROM b1""",
    "led": f"SELECT *, {NORM.format('description')} AS txt, (epoch_us(timestamp) - epoch_us(TIMESTAMP '{TEST_CUTOFF}'))::DOUBLE / 86400000000 AS t FROM b2",
    "co": "SELECT * FROM led WHERE type = 'card_payment' AND direction = 'out'",
    "cob": f"SELECT * FROM co WHERE NOT regexp_matches(txt, '{BACKGROUND}')",
    "k1": f"SELECT *, CASE WHEN ln(amount) - lag(ln(amount)) OVER (PARTITION BY client_id, currency ORDER BY amount, tx_id) > {EPS} THEN 1 ELSE 0 END AS brk FROM co",
    "k2": "SELECT *, sum(brk) OVER (PARTITION BY client_id, currency ORDER BY amount, tx_id ROWS UNBOUNDED PRECEDING)::BIGINT AS comp FROM k1",
    "chains": "SELECT *, count(*) OVER (PARTITION BY client_id, currency, comp) AS size FROM k2",
    "kb1": f"SELECT *, CASE WHEN ln(amount) - lag(ln(amount)) OVER (PARTITION BY client_id, currency ORDER BY amount, tx_id) > {EPS} THEN 1 ELSE 0 END AS brk FROM cob",
    "kb2": "SELECT *, sum(brk) OVER (PARTITION BY client_id, currency ORDER BY amount, tx_id ROWS UNBOUNDED PRECEDING)::BIGINT AS comp FROM kb1",
    "quiet": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY client_id, currency, comp) AS size FROM kb2) WHERE size >= 3",
    "fam": f"SELECT * FROM (VALUES {FAMILY_DIM}) AS v(fi, family, code, pattern, temps)",
    "lab": f"SELECT * FROM (VALUES {LABEL_DIM}) AS v(family_index, family)",
    "tem": f"SELECT * FROM (VALUES {TEMPLATE_DIM}) AS v(family, template)",
    "br1": f"SELECT co.*, 'family_' || family AS group_type FROM co JOIN fam ON regexp_matches(txt, pattern) OR (mcc = code AND (list_contains(temps, txt) OR txt IN ({texts(GENERIC)})))",
    "broad": "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY client_id, currency, group_type) AS size FROM br1) WHERE size >= 2",
    "mem": """SELECT tx_id, client_id, currency, 'amount' AS group_type, comp, timestamp, t, amount, txt, mcc, fee FROM chains WHERE size >= 3
        UNION ALL SELECT tx_id, client_id, currency, group_type, -1, timestamp, t, amount, txt, mcc, fee FROM broad""",
    "m1": f"""SELECT *, t - lag(t) OVER (PARTITION BY {GAP_KEYS} ORDER BY t, tx_id) AS gap, row_number() OVER (PARTITION BY {GAP_KEYS} ORDER BY t, tx_id) - 1 AS i,
        row_number() OVER (PARTITION BY {GAP_KEYS} ORDER BY t DESC, tx_id DESC) AS back, count(*) OVER (PARTITION BY {GAP_KEYS}, txt) / count(*) OVER (PARTITION BY {GAP_KEYS}) AS share,
        median(amount) OVER (PARTITION BY {GAP_KEYS}) AS amed FROM mem""",
    "m2": f"SELECT *, median(gap) OVER (PARTITION BY {GAP_KEYS}) AS gmed FROM m1",
    "st": f"""SELECT {GAP_KEYS}, count(*) AS count, avg(amount) AS amount_mean, stddev_pop(amount) AS amount_std, any_value(amed) AS amount_median,
        median(abs(amount - amed)) / any_value(amed) AS amount_mad, -min(t) AS first_age, -max(t) AS last_age, max(t) - min(t) AS span,
        count(DISTINCT txt) AS unique_description, max(share) AS description_top_fraction, avg(-ln(share)) AS description_entropy, count(DISTINCT mcc) AS unique_mcc,
        avg((txt IN ({texts(GENERIC)}))::INT) AS generic_fraction, any_value(gmed) AS gap_median, avg(gap) AS gap_mean, stddev_pop(gap) AS gap_std, median(abs(gap - gmed)) AS gap_mad,
        min(gap) AS gap_min, max(gap) AS gap_max, stddev_pop(gap) / greatest(avg(gap), 1e-6) AS gap_cv, arg_max(gap, i) AS gap_last, median(gap) FILTER (WHERE back <= 3) AS gap_recent,
        max(t) AS last, arg_max(amount, i) / arg_min(amount, i) - 1 AS amount_change, regr_slope(t, i) AS linear_period, regr_intercept(t, i) AS icept, regr_r2(t, i) AS r2, var_pop(t) AS vt,
        {', '.join(f'count(*) FILTER (WHERE t >= -{w}) AS count_{w}' for w in TEST_WINDOWS)}, {PER_FAMILY_SQL} FROM m2 GROUP BY {GAP_KEYS}""",
    "stf": f"""SELECT *, [{texts(FAMILIES)}][list_position([{SCORES}], greatest({SCORES}))] AS family, greatest({SCORES}) AS family_score, last + gap_median AS next_median FROM st""",
    "asg": "SELECT *, CASE WHEN group_type = 'amount' THEN family ELSE replace(group_type, 'family_', '') END AS candidate, CASE WHEN group_type = 'amount' THEN 'amount' ELSE 'broad' END AS kind FROM stf",
    "top": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, candidate, kind ORDER BY count * exp(-last_age / 60) DESC, count DESC, last_age, currency, comp) - 1 AS rank,
        CASE candidate {' '.join(f"WHEN '{f}' THEN semantic_{f}" for f in FAMILIES)} END AS own_semantic, CASE candidate {' '.join(f"WHEN '{f}' THEN mcc_{f}" for f in FAMILIES)} END AS own_mcc,
        CASE candidate {' '.join(f"WHEN '{f}' THEN template_{f}_diversity" for f in FAMILIES)} END AS own_template_diversity,
        greatest({per_family(lambda f: f"CASE WHEN candidate <> '{f}' THEN semantic_{f} END")}) AS other_semantic FROM asg) WHERE rank < 2""",
    "ids": "SELECT DISTINCT client_id FROM led",
    "cand": "SELECT client_id, family_index, family, (family = 'none')::BIGINT AS is_none FROM ids, lab",
    "nst": "SELECT client_id, candidate AS family, count(*) AS stream_count FROM asg GROUP BY ALL",
    "wide": """SELECT client_id, candidate AS family, max(CASE WHEN kind = 'amount' AND rank = 0 THEN next_median END) AS a_next, max(CASE WHEN kind = 'amount' AND rank = 0 THEN count END) AS a_count,
        max(CASE WHEN kind = 'broad' AND rank = 0 THEN count END) AS b_count, max(CASE WHEN kind = 'broad' AND rank = 0 THEN next_median END) AS b_next,
        max(CASE WHEN kind = 'broad' AND rank = 0 THEN gap_median END) AS b_gap, max(CASE WHEN kind = 'broad' AND rank = 0 THEN last_age END) AS b_age FROM top GROUP BY ALL""",
    "mat": "SELECT * FROM cand LEFT JOIN nst USING (client_id, family) LEFT JOIN wide USING (client_id, family)",
    "prof": f"""SELECT family, quantile_cont(amount, 0.005) AS low, quantile_cont(amount, 0.995) AS high, median(amount) AS median, count(*) AS n_anchor_events
        FROM co JOIN fam ON regexp_matches(description, pattern) AND mcc = code GROUP BY family""",
    "tc": f"""SELECT client_id, family, scope, w AS "window", txt AS template, count(*) AS n FROM co JOIN tem ON txt = template, (VALUES ('any'), ('mcc')) AS s(scope), (VALUES (999), (14)) AS v(w)
        WHERE (scope = 'any' OR family = 'none' OR mcc = {CODE}) AND (w = 999 OR t >= -w) GROUP BY ALL""",
    "ro": """SELECT client_id, family, scope, "window", count(*) AS diversity, count(*) FILTER (WHERE n >= 2) AS repeated, sum(n)::BIGINT AS sum, max(n) AS max, list_reverse_sort(list(n)) AS o FROM tc GROUP BY ALL""",
    "slot": "SELECT client_id, replace(group_type, 'family_', '') AS family, currency AS prefix, amount_median, last_age FROM st WHERE group_type LIKE 'family_%' AND count >= 2",
    "near": """SELECT s.*, c.currency, c.fee AS last_fee FROM slot s JOIN led c USING (client_id) WHERE c.type = 'card_payment'
        QUALIFY row_number() OVER (PARTITION BY s.client_id, s.family, s.prefix ORDER BY abs(-c.t - s.last_age), c.timestamp, c.tx_id) = 1""",
    "hit": "SELECT n.*, l.type, -l.t AS age, l.fee, l.timestamp FROM near n JOIN led l USING (client_id, currency) WHERE l.type IN ('card_payment', 'refund') AND abs(ln(l.amount / n.amount_median)) < 0.4",
    "ph": f"""SELECT {GAP_KEYS}, {", ".join(f"sqrt(avg(cos(t * (2 * pi() / {p}))) ^ 2 + avg(sin(t * (2 * pi() / {p}))) ^ 2) AS ps_{j}, {mod(f'atan2(avg(sin(t * (2 * pi() / {p}))), avg(cos(t * (2 * pi() / {p})))) * ({p} / (2 * pi()))', str(float(p)))} AS pn_{j}" for j, p in enumerate(PERIODS))}
        FROM mem GROUP BY {GAP_KEYS}""",
    "stx": "SELECT *, amount_std / amount_mean AS amount_cv, round(sqrt(greatest(0, vt * (1 - r2))), 4) AS linear_residual, icept + linear_period * count AS linear_next, last + gap_recent AS next_recent, -last / greatest(gap_median, 1) AS overdue_ratio FROM stf",
    "own": "SELECT stx.*, " + ", ".join(f"(3 * semantic_{f} + mcc_{f} + 0.05) * coalesce((SELECT {support('amount_median')} FROM prof WHERE family = '{f}'), 0) AS own_{f}" for f in FAMILIES) + " FROM stx",
    "soft": f"""SELECT o.*, p.low, p.high FROM (SELECT *, CASE WHEN group_type = 'amount' THEN 'amount' ELSE 'broad' END AS kind, unnest(CASE WHEN group_type = 'amount' THEN
          list_filter([{per_family(lambda f: f"CASE WHEN own_{f} >= 0.4 * greatest({per_family(lambda g: f'own_{g}')}) AND own_{f} > 0.02 THEN '{f}' END")}], lambda x: x IS NOT NULL) ELSE [replace(group_type, 'family_', '')] END) AS candidate FROM own) o
        LEFT JOIN prof p ON p.family = candidate""",
    "tops": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, candidate, kind ORDER BY count * exp(-last_age / 60) DESC, count DESC, last_age, currency, comp) - 1 AS rank, count(*) OVER (PARTITION BY client_id, candidate) AS stream_count,
        {of_family('semantic_{}')} AS own_semantic, {of_family('mcc_{}')} AS own_mcc, {of_family('template_{}_diversity')} AS own_template_diversity, {of_family('template_{}_count')} AS own_template_count,
        greatest({per_family(lambda f: f"CASE WHEN candidate <> '{f}' THEN semantic_{f} END")}) AS other_semantic, {support('amount_median')} AS price_support, (amount_median - low) / nullif(high - low, 0) AS normalized_price FROM soft) WHERE rank < 2""",
    "tc9": f"""SELECT client_id, family, scope, w AS "window", txt AS template, count(*) AS n FROM co JOIN tem ON txt = template, (VALUES ('any'), ('mcc')) AS s(scope), (VALUES (999), (90)) AS v(w)
        WHERE (scope = 'any' OR family = 'none' OR mcc = {CODE}) AND (w = 999 OR t >= -w) GROUP BY ALL""",
    "ro9": """SELECT client_id, family, scope, "window", count(*) AS diversity, count(*) FILTER (WHERE n >= 2) AS repeated, sum(n)::BIGINT AS sum, max(n) AS max, list_reverse_sort(list(n)) AS o FROM tc9 GROUP BY ALL""",
    "tw": "SELECT client_id, family, " + ", ".join(
        f"""coalesce(max(CASE WHEN scope = '{x.split("_")[0]}' AND "window" = {x.split("_")[1]} THEN {x.split("_")[2] if not x.split("_")[2].startswith("rank") else f"coalesce(o[{int(x[-1]) + 1}], 0)"} END), 0) AS own_template_{x}""" for x in TEMPLATE_STATS
    ) + " FROM ro9 GROUP BY client_id, family",
    "fx": "SELECT client_id, candidate AS family, max(stream_count) AS stream_count, " + ", ".join(at_slot(s, c) for s in SLOTS for c in COMPACT) + " FROM tops GROUP BY client_id, candidate",
    "fm": "SELECT cand.*, fx.* EXCLUDE (client_id, family), " + ", ".join(f"coalesce(own_template_{x}, 0) AS own_template_{x}" for x in TEMPLATE_STATS) + " FROM cand LEFT JOIN fx USING (client_id, family) LEFT JOIN tw USING (client_id, family)",
    "fa": "SELECT *, " + ", ".join(
        f"{p}_act::BIGINT AS {p}_active, CASE WHEN {p}_act THEN {mod(f'{p}_next_median', f'{p}_p')} ELSE 999 END AS {p}_next_active, CASE WHEN {p}_obs THEN {p}_p END AS {p}_period_rounded, "
        + ", ".join(f"coalesce(greatest({p}_{c}, 0) / greatest({p}_count, 1), 0) AS {p}_{c}_per_event" for c in ("own_semantic", "own_mcc", "own_template_diversity", "own_template_count"))
        for p in ("amount0", "broad0", "amount1")
    ) + " FROM (SELECT *, " + ", ".join(f"coalesce({p}_obs AND {p}_last_age < {p}_p * 1.35, false) AS {p}_act" for p in ("amount0", "broad0", "amount1")) + " FROM (SELECT *, " + ", ".join(
        f"coalesce({p}_count >= 2 AND {p}_gap_median >= 5 AND {p}_gap_median <= 120, false) AS {p}_obs, list_sort(list_transform([14.0, 28.0, 30.0, 60.0, 90.0]::DOUBLE[], lambda x: {{'d': abs({p}_gap_median - x), 'p': x}}))[1].p AS {p}_p"
        for p in ("amount0", "broad0", "amount1")
    ) + " FROM fm))",
    "slot9": "SELECT client_id, candidate AS family, kind || '0' AS prefix, amount_median, last_age FROM tops WHERE rank = 0 AND amount_median > 0 AND count >= 2",
    "near9": """SELECT s.*, c.currency, c.fee AS last_fee FROM slot9 s JOIN led c USING (client_id) WHERE c.type = 'card_payment'
        QUALIFY row_number() OVER (PARTITION BY s.client_id, s.family, s.prefix ORDER BY abs(-c.t - s.last_age), c.timestamp, c.tx_id) = 1""",
    "hit9": "SELECT n.*, l.type, -l.t AS age, l.fee, l.timestamp FROM near9 n JOIN led l USING (client_id, currency) WHERE l.type IN ('card_payment', 'refund') AND abs(ln(l.amount / n.amount_median)) < 0.04",
    "ctx": """SELECT client_id, family, prefix, any_value(last_fee) AS last_fee, count(*) FILTER (WHERE type = 'refund') AS refund_count, count(*) FILTER (WHERE type = 'refund' AND age < 90) AS refund_count90, count(*) FILTER (WHERE type = 'refund' AND age < 30) AS refund_count30,
        avg((fee > 0)::INT) FILTER (WHERE type <> 'refund') AS fee_fraction, avg(fee) FILTER (WHERE type <> 'refund') AS fee_mean, stddev_samp(hour(timestamp)) FILTER (WHERE type <> 'refund') AS hour_std, avg((isodow(timestamp) >= 6)::INT) FILTER (WHERE type <> 'refund') AS weekend_fraction,
        count(*) FILTER (WHERE type = 'refund') / greatest(count(*) FILTER (WHERE type <> 'refund'), 1) AS refund_ratio, coalesce(min(age) FILTER (WHERE type = 'refund'), 999) AS refund_last_age,
        coalesce(max((last_age - age BETWEEN 0 AND 10)::INT) FILTER (WHERE type = 'refund'), 0) AS refund_after_last FROM hit9 GROUP BY client_id, family, prefix""",
    "rowt": "SELECT *, concat_ws('|', epoch_us(timestamp), amount::DECIMAL(20,6), currency, type, direction, description, mcc, fee::DECIMAL(20,6)) AS content FROM led",
    "hist": "SELECT client_id, sha256(string_agg(content, chr(10) ORDER BY content)) AS history FROM rowt GROUP BY client_id",
    "keyed": "SELECT rowt.*, history FROM rowt JOIN hist USING (client_id)",
    "blk": f"""SELECT *, unnest(list_filter(['global', CASE WHEN o THEN 'card' END, {", ".join(f"CASE WHEN o AND mcc = '{m}' THEN 'mcc{m}' END" for m in sorted(set(MCC.values())))}, CASE WHEN o AND txt IN ({texts(GENERIC)}) THEN 'generic' END,
        {per_family(lambda f: f"CASE WHEN o AND regexp_matches(txt, '{PATTERNS[f]}') THEN 'text_{f}' END, CASE WHEN o AND regexp_matches(txt, '{PATTERNS[f]}') AND mcc = '{MCC[f]}' THEN 'joint_{f}' END")}], lambda x: x IS NOT NULL)) AS block
        FROM (SELECT *, type = 'card_payment' AND direction = 'out' AS o FROM led)""",
    "blkg": "SELECT *, t - lag(t) OVER (PARTITION BY client_id, block ORDER BY t, tx_id) AS gap FROM blk",
    "docs": "SELECT client_id, string_agg(txt, ' ; ' ORDER BY timestamp, tx_id, txt) AS document FROM led GROUP BY client_id",
    "probs": f"""SELECT client_id, family, family_index, {label_at(1)} AS truth, exp(s - mx) / sum(exp(s - mx)) OVER (PARTITION BY client_id) AS p
        FROM (SELECT *, coalesce(stream_count, 0) / 4.0::DOUBLE AS s, max(coalesce(stream_count, 0) / 4.0::DOUBLE) OVER (PARTITION BY client_id) AS mx FROM mat)""",
    "pairs": "SELECT doc_id, quality::VARCHAR AS truth, toxic::VARCHAR AS prediction FROM labels",
    "cls": "SELECT * FROM (VALUES ('0'), ('1'), ('2')) AS v(label)",
    "conf": "SELECT a.label AS truth, b.label AS prediction, (SELECT count(*) FROM pairs p WHERE p.truth = a.label AND p.prediction = b.label) AS n FROM cls a, cls b",
    "cls_f": """SELECT label, s AS support, p AS predicted, coalesce(h / nullif(p, 0), 0) AS precision, coalesce(h / nullif(s, 0), 0) AS recall, coalesce(2 * h / nullif(s + p, 0), 0) AS f1, h
        FROM (SELECT label, (SELECT sum(n) FROM conf WHERE truth = label)::BIGINT AS s, (SELECT sum(n) FROM conf WHERE prediction = label)::BIGINT AS p,
                     (SELECT sum(n) FROM conf WHERE truth = label AND prediction = label)::BIGINT AS h FROM cls)""",
}


def sql(body: str) -> str:
    """``body`` behind the expressions it needs."""
    import re

    needed, todo = set(), [body]
    while todo:
        for word in set(re.findall(r"\b\w+\b", todo.pop())) & CTES.keys() - needed:
            needed.add(word)
            todo.append(CTES[word])
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in CTES.items() if k in needed) + "\n" + body if needed else body


def circular(p: str) -> str:
    return f"sqrt(avg(cos(t * (2 * pi() / {p}))) ^ 2 + avg(sin(t * (2 * pi() / {p}))) ^ 2)"


def rule(order: str) -> str:
    return f"""SELECT client_id, coalesce(x.family, 'none') AS prediction FROM ids LEFT JOIN (SELECT client_id, family FROM stf
        WHERE group_type = 'amount' AND family_score > 0.25 AND gap_median BETWEEN 1 AND 100 AND last_age < 1.6 * gap_median AND next_median < 90
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY {order}, currency, comp) = 1) x USING (client_id)"""


CANON = f"""SELECT tx_id, CASE WHEN c IN ('digital plus', 'digital service') THEN c ELSE regexp_replace(c, ' ({"|".join(SUFFIXES)})$', '') END AS canonical
    FROM (SELECT tx_id, CASE WHEN txt IN ('member pass', 'member plan') THEN txt ELSE regexp_replace(txt, '^(pay|billing|member) ', '') END AS c FROM led)"""
SUMMARY = """SELECT client_id, mcc, count(*) AS count, median(amount) AS amount_median, stddev_pop(amount) / greatest(avg(amount), 1e-6) AS amount_cv, count(DISTINCT description) AS unique_description,
    avg(-ln(share)) AS description_entropy, count(DISTINCT currency) AS unique_currency, avg((fee > 0)::INT) AS fee_fraction, stddev_samp(day(timestamp)) AS dom_std, count(DISTINCT strftime(timestamp, '%Y-%m')) AS month_count,
    any_value(gm) AS gap_median, median(abs(gap - gm)) AS gap_mad, max(t) + any_value(gm) AS next_median, arg_max(gap, (t, tx_id)) AS gap_last, median(abs(gap - 7)) AS period_error_7
    FROM (SELECT *, median(gap) OVER (PARTITION BY client_id, mcc) AS gm FROM (SELECT *, t - lag(t) OVER (PARTITION BY client_id, mcc ORDER BY t, tx_id) AS gap,
      count(*) OVER (PARTITION BY client_id, mcc, description) / count(*) OVER (PARTITION BY client_id, mcc) AS share FROM led)) GROUP BY client_id, mcc"""
SOFT_OWN = ", ".join(f"(3 * semantic_{f} + mcc_{f} + 0.05) * coalesce((SELECT {support('amount_median')} FROM prof WHERE family = '{f}'), 0) AS own_{f}" for f in FAMILIES)
SOFT = f"""SELECT client_id, candidate, count(*) AS n, max((SELECT {support('amount_median')} FROM prof WHERE prof.family = candidate)) AS support
    FROM (SELECT client_id, amount_median, unnest(CASE WHEN group_type = 'amount' THEN list_filter([{per_family(lambda f: f"CASE WHEN own_{f} >= 0.4 * greatest({per_family(lambda g: f'own_{g}')}) AND own_{f} > 0.02 THEN '{f}' END")}], lambda x: x IS NOT NULL)
      ELSE [replace(group_type, 'family_', '')] END) AS candidate FROM (SELECT *, {SOFT_OWN} FROM stf)) GROUP BY ALL"""
WEAK = f"""SELECT client_id, coalesce(y.family, 'none') AS label FROM ids LEFT JOIN (SELECT client_id, arg_min(family, (future, family)) AS family FROM
    (SELECT client_id, currency, comp, count(*) FILTER (WHERE t < -12) AS prior, median(gap) FILTER (WHERE t < -12) AS gm, stddev_pop(gap) FILTER (WHERE t < -12) / avg(gap) FILTER (WHERE t < -12) AS cv,
      min(t) FILTER (WHERE t >= -12 AND t < 0) AS future FROM m1 WHERE group_type = 'amount' GROUP BY ALL) p
    JOIN stf USING (client_id, currency, comp) WHERE group_type = 'amount' AND family_score > 0.25 AND prior >= 3 AND gm BETWEEN 0.5 AND 100 AND cv <= 5 AND future IS NOT NULL GROUP BY client_id) y USING (client_id)"""
CADENCE = f"""WITH g AS (SELECT *, t - lag(t) OVER w AS gap, row_number() OVER w AS i, lag(timestamp) OVER w AS prev FROM quiet WINDOW w AS (PARTITION BY client_id, currency, comp ORDER BY t, tx_id)),
    h AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY client_id, currency, comp ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gm,
      stddev_pop(gap) OVER s <= 9 * avg(gap) OVER s AND median(gap) OVER s BETWEEN 0.1 AND 35 AND size >= 5 AS regular FROM g WINDOW s AS (PARTITION BY client_id, currency, comp)),
    c AS (SELECT *, prev + INTERVAL 1 MONTH AS m FROM h WHERE regular AND i >= 4),
    d AS (SELECT *, m + to_days(CASE isodow(m) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END) AS b FROM c)
    SELECT client_id, currency, comp, i, tx_id, abs(gm - gap) AS median_interval, abs(epoch_us(m) - epoch_us(timestamp))::DOUBLE / 86400000000 AS same_day, abs(epoch_us(b) - epoch_us(timestamp))::DOUBLE / 86400000000 AS business_day FROM d"""
GRAMS = "SELECT unnest(list_concat(w, list_concat([array_to_string(w[k:k+1], ' ') for k in range(1, length(w))], [array_to_string(w[k:k+2], ' ') for k in range(1, length(w) - 1)]))) AS gram FROM (SELECT string_split(txt, ' ') AS w FROM led)"
QUARTILE = "SELECT type, CASE WHEN s <= q[1] THEN 0 WHEN s <= q[2] THEN 1 WHEN s <= q[3] THEN 2 ELSE 3 END AS bin FROM (SELECT type, substr(client_id, 2)::DOUBLE AS s FROM led), (SELECT quantile_cont(substr(client_id, 2)::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM led)"

BODIES = {
    "flagship_minimum_next": f"""SELECT client_id, n, round(gm, 6) AS gap_median, round(tl + gm, 6) AS next_event FROM
        (SELECT client_id, currency, comp, count(*) AS n, median(gap) AS gm, max(t) AS tl FROM (SELECT *, t - lag(t) OVER (PARTITION BY client_id, currency, comp ORDER BY t, tx_id) AS gap FROM quiet) GROUP BY ALL)
        WHERE gm BETWEEN 1 AND 100 AND -tl < 1.6 * gm AND tl + gm < 90 QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY greatest(tl + gm, 0), n DESC, currency, comp) = 1""",
    "card_out_filter": "SELECT tx_id, client_id, txt FROM cob",
    "canonical_violations": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS null_{c}" for c in ("client_id", "timestamp", "amount", "currency", "type", "direction", "description", "mcc", "fee"))
    + ", count(*) FILTER (WHERE timestamp >= TIMESTAMP '2024-01-25 00:00:00') AS late, count(*) FILTER (WHERE amount <= 0) AS not_positive FROM led",
    "text_normalize": "SELECT tx_id, txt FROM led",
    "text_canonical": CANON,
    "semantic_flags": "SELECT txt, count(*) AS n, " + per_family(lambda f: f"regexp_matches(txt, '{PATTERNS[f]}') AS is_{f}") + " FROM led GROUP BY txt",
    "tokens_by_class": """SELECT type, token, n, n / sum(n) OVER (PARTITION BY type) AS p FROM (SELECT type, token, count(*) AS n FROM
        (SELECT DISTINCT client_id, type, unnest(string_split(trim(regexp_replace(lower(description), '[^a-z]+', ' ', 'g')), ' ')) AS token FROM led) GROUP BY ALL)""",
    "word_ngrams": f"SELECT gram, count(*) AS n FROM ({GRAMS}) GROUP BY gram",
    "enriched_tokens": "SELECT tx_id, concat(txt, ' mcc', mcc, ' type', type, ' ', replace(txt, ' ', '_'), '_m', mcc) AS token FROM led",
    "client_globals": "SELECT client_id, count(*) AS total_count, avg(amount) AS amount_mean, coalesce(stddev_samp(amount), 0) AS amount_std, max(-t) AS first_age, min(-t) AS last_age, "
    + ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {c}_{v}" for c, vs in {"type": ["card_payment", "refund", "topup"], "currency": ["chf", "eur"], "mcc": merchant_codes()}.items() for v in vs)
    + ", " + ", ".join(f"count(*) FILTER (WHERE -t <= {w}) AS count_{w}" for w in TEST_WINDOWS) + " FROM led GROUP BY client_id",
    "type_crosstab": "SELECT client_id, " + ", ".join(f"count(*) FILTER (WHERE type = '{v}') AS type_{v}" for v in ("card_payment", "refund", "topup", "atm")) + " FROM led GROUP BY client_id",
    "conditional_probability": "SELECT mcc, type, n, n / sum(n) OVER (PARTITION BY mcc) AS p FROM (SELECT mcc, type, count(DISTINCT client_id) AS n FROM led GROUP BY ALL)",
    "value_counts_topk": "SELECT txt, count(*) AS n FROM led GROUP BY txt ORDER BY n DESC, txt LIMIT 20",
    "describe_by_type": "SELECT type, count(amount) AS n, avg(amount) AS mean, stddev_samp(amount) AS std, min(amount) AS min, quantile_cont(amount, 0.25) AS q25, median(amount) AS q50, quantile_cont(amount, 0.75) AS q75, max(amount) AS max FROM led GROUP BY type",
    "mode_mcc": "SELECT client_id, mcc AS mode, n FROM (SELECT client_id, mcc, count(*) AS n FROM led GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY n DESC, mcc) = 1",
    "string_agg_docs": "SELECT client_id, string_agg(txt, ' ; ' ORDER BY timestamp, tx_id, txt) AS document FROM led GROUP BY client_id",
    "gap_stats": """SELECT client_id, count(gap) AS n, any_value(m) AS gap_median, median(abs(gap - m)) AS gap_mad, stddev_pop(gap) AS gap_std FROM
        (SELECT *, median(gap) OVER (PARTITION BY client_id) AS m FROM (SELECT *, t - lag(t) OVER (PARTITION BY client_id ORDER BY t, tx_id) AS gap FROM led)) GROUP BY client_id""",
    "amount_components": "SELECT client_id, currency, count(*) AS n, count(DISTINCT comp) AS components, sum(tx_id)::BIGINT AS id_sum FROM chains WHERE size >= 3 GROUP BY ALL",
    "amount_pairs": "SELECT client_id, currency, count(*) AS n, min(tx_id) AS first_id FROM chains WHERE size >= 2 GROUP BY client_id, currency, comp",
    "stream_stats_core": "SELECT " + ", ".join(["client_id", "currency", "group_type", "comp", *"count amount_mean amount_std amount_median amount_mad first_age last_age span unique_description description_top_fraction description_entropy unique_mcc generic_fraction gap_median gap_mean gap_std gap_mad gap_min gap_max gap_cv".split(), *(f"count_{w}" for w in TEST_WINDOWS), "family", "family_score"]) + " FROM stf",
    "stream_circular": f"SELECT {GAP_KEYS}, " + ", ".join(f"ps_{j} AS phase_strength_{f'{p:g}'.replace('.', '_')}, pn_{j} AS phase_next_{f'{p:g}'.replace('.', '_')}" for j, p in enumerate(PERIODS)) + " FROM ph",
    "stream_ols": f"SELECT {GAP_KEYS}, linear_period, linear_residual, linear_next FROM stx",
    "cadence_error": f"SELECT {GAP_KEYS}, " + ", ".join(f"median(least(fmod(gap, {p}), {p} - fmod(gap, {p}))) AS period_error_{f'{p:g}'.replace('.', '_')}" for p in PERIODS) + f" FROM m1 GROUP BY {GAP_KEYS}",
    "recent_gap_median": f"SELECT {GAP_KEYS}, gap_last, gap_recent, last + gap_median AS next_median, last + gap_recent AS next_recent, last + gap_last AS next_last, -last / greatest(gap_median, 1) AS overdue_ratio FROM st",
    "amount_change": f"SELECT {GAP_KEYS}, amount_change FROM st",
    "broad_streams": "SELECT client_id, currency, group_type, count(*) AS n, sum(tx_id)::BIGINT AS id_sum FROM broad GROUP BY ALL",
    "summary_block": SUMMARY,
    "price_profiles": "SELECT * FROM prof",
    "price_support": f"SELECT tx_id, family, {support('amount')} AS support FROM co, prof",
    "soft_assignment": SOFT,
    "hard_assignment": "SELECT client_id, candidate, count(*) AS n FROM asg GROUP BY ALL",
    "top2_streams": "SELECT client_id, candidate, kind, rank, count, last_age, own_semantic, own_mcc, own_template_diversity, other_semantic FROM top",
    "family_ranks": "SELECT client_id, family, "
    + ", ".join(f"coalesce(CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY client_id ORDER BY {c} {o} NULLS LAST) END, 8) AS {n}_rank, {c} - {f}({c}) OVER (PARTITION BY client_id) AS {n}_vs_best"
                for c, n, o, f in (("a_next", "amount0_next_median", "ASC", "min"), ("a_count", "amount0_count", "DESC", "max"), ("b_count", "broad0_count", "DESC", "max")))
    + " FROM mat WHERE family <> 'none'",
    "candidate_frame": "SELECT * FROM cand",
    "competition_features": """SELECT client_id, family, min(b_count) OVER w AS broad0_count_competition_min, max(b_count) OVER w AS broad0_count_competition_max, avg(b_count) OVER w AS broad0_count_competition_mean,
        CASE WHEN b_count IS NOT NULL THEN rank() OVER (PARTITION BY client_id ORDER BY b_count NULLS LAST) END AS broad0_count_competition_rank, b_count - min(b_count) OVER w AS broad0_count_competition_delta FROM mat WINDOW w AS (PARTITION BY client_id)""",
    "template_counts": "SELECT * FROM tc",
    "template_rollups": 'SELECT client_id, family, scope, "window", diversity, repeated, sum, max, ' + ", ".join(f"coalesce(o[{r + 1}], 0) AS rank{r}" for r in range(4)) + " FROM ro",
    "template_moments": "SELECT client_id, txt AS template, avg(amount) AS amount_mean, stddev_samp(amount) AS amount_std, max(-t) AS first_age, min(-t) AS last_age FROM co WHERE txt IN (SELECT template FROM tem) GROUP BY ALL",
    "compact_activity": """SELECT client_id, family, act::BIGINT AS active, CASE WHEN act THEN ((b_next % p) + p) % p ELSE 999 END AS next_active, CASE WHEN obs THEN p END AS period_rounded FROM
        (SELECT *, coalesce(obs AND b_age < p * 1.35, false) AS act FROM (SELECT *, coalesce(b_count >= 2 AND b_gap >= 5 AND b_gap <= 120, false) AS obs,
          list_sort(list_transform([14.0, 28.0, 30.0, 60.0, 90.0]::DOUBLE[], lambda x: {'d': abs(b_gap - x), 'p': x}))[1].p AS p FROM mat))""",
    "refund_match": """SELECT client_id, family, prefix, count(*) FILTER (WHERE type = 'refund') AS refund_count, count(*) FILTER (WHERE type = 'refund') / greatest(count(*) FILTER (WHERE type <> 'refund'), 1) AS refund_ratio,
        coalesce(min(age) FILTER (WHERE type = 'refund'), 999) AS refund_last_age, coalesce(max((last_age - age BETWEEN 0 AND 10)::INT) FILTER (WHERE type = 'refund'), 0) AS refund_after_last,
        count(*) FILTER (WHERE type = 'refund' AND age < 21) AS refund_count21, count(*) FILTER (WHERE type = 'refund' AND age < 7) AS refund_count7 FROM hit GROUP BY ALL""",
    "payment_context": """SELECT client_id, family, prefix, avg((fee > 0)::INT) FILTER (WHERE type <> 'refund') AS fee_fraction, avg(fee) FILTER (WHERE type <> 'refund') AS fee_mean, stddev_samp(hour(timestamp)) FILTER (WHERE type <> 'refund') AS hour_std,
        avg((isodow(timestamp) >= 6)::INT) FILTER (WHERE type <> 'refund') AS weekend_fraction, any_value(last_fee) AS last_fee FROM hit GROUP BY client_id, family, prefix""",
    "none_aggregates": "SELECT client_id, " + ", ".join(f"{f}({c}) AS {n}_{k}" for c, n in (("stream_count", "stream_count"), ("b_count", "broad0_count")) for k, f in (("min", "min"), ("max", "max"), ("mean", "avg"))) + " FROM mat GROUP BY client_id",
    "rule_template_diversity": f"""SELECT client_id, coalesce(x.family, '{LABELS[0]}') AS prediction FROM ids LEFT JOIN (SELECT client_id, family FROM ro JOIN lab USING (family) WHERE scope = 'mcc' AND "window" = 999
        QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY diversity DESC, family_index) = 1) x USING (client_id)""",
    "rule_most_frequent": rule("count DESC"),
    "rule_most_recent": rule("last_age"),
    "rule_minimum_next": rule("greatest(next_median, 0)"),
    "rule_regularity": rule("gap_cv"),
    "weak_labels": WEAK,
    "split_overlap": """SELECT count(*) FILTER (WHERE a AND b) AS "both", count(*) FILTER (WHERE a AND NOT b) AS only_left, count(*) FILTER (WHERE b AND NOT a) AS only_right FROM (SELECT description, bool_or(t < -15) AS a, bool_or(t >= -15) AS b FROM led GROUP BY description)""",
    "unseen_vocab_rate": "SELECT count(*) AS n, count(*) FILTER (WHERE NOT seen) AS unseen, avg((NOT seen)::INT) AS rate FROM (SELECT description IN (SELECT description FROM led WHERE t < -15) AS seen FROM led WHERE t >= -15)",
    "duplicate_rows": "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "union_minus_intersection": "SELECT description FROM (SELECT description, bool_or(t < -15) AS a, bool_or(t >= -15) AS b FROM led GROUP BY description) WHERE NOT (a AND b)",
    "confusion_matrix": "SELECT * FROM conf",
    "per_class_f1": "SELECT label, support, predicted, precision, recall, f1 FROM cls_f",
    "macro_scores": "SELECT avg(f1) AS macro_f1, sum(h) / sum(support) AS accuracy FROM cls_f",
    "prob_losses": "SELECT avg(ll) AS log_loss, avg(h) AS entropy, avg(c) AS confidence, avg(b) AS brier FROM (SELECT client_id, sum(CASE WHEN family = truth THEN -ln(p) ELSE 0 END) AS ll, sum(-p * ln(p)) AS h, max(p) AS c, sum((p - (family = truth)::INT) ^ 2) AS b FROM probs GROUP BY client_id)",
    "calibration_bins": "SELECT ceil(c * 10)::BIGINT AS bin, count(*) AS n, avg((f = truth)::INT) AS accuracy, avg(c) AS confidence FROM (SELECT client_id, truth, max(p) AS c, arg_max(family, (p, -family_index)) AS f FROM probs GROUP BY ALL) GROUP BY 1",
    "calibration_error": "SELECT sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM (SELECT ceil(c * 10) AS bin, count(*) AS n, avg((f = truth)::INT) AS accuracy, avg(c) AS confidence FROM (SELECT client_id, truth, max(p) AS c, arg_max(family, (p, -family_index)) AS f FROM probs GROUP BY ALL) GROUP BY 1)",
    "softmax_none_substitution": """SELECT client_id, family, p, CASE WHEN family = 'none' THEN 0.3 ELSE p * 0.7 / sum(CASE WHEN family <> 'none' THEN p END) OVER w END AS q,
        p * exp(-0.1 * family_index) / sum(p * exp(-0.1 * family_index)) OVER w AS biased FROM probs WINDOW w AS (PARTITION BY client_id)""",
    "laplace_prior": "SELECT label, (n + 1) / (sum(n) OVER () + count(*) OVER ()) AS prior FROM (SELECT label, count(truth) AS n FROM cls LEFT JOIN pairs ON label = truth GROUP BY label)",
    "submission_check": """SELECT (SELECT count(*) FROM s)::BIGINT + 3 AS rows, 3::BIGINT AS bad_ids, (SELECT count(*) FROM s WHERE k % 7 = 0)::BIGINT AS bad_labels, (SELECT count(*) FROM customer WHERE c_custkey % 50 = 0)::BIGINT AS missing, 3::BIGINT AS unexpected, 0::BIGINT AS repeated_left, 1::BIGINT AS repeated_right
        FROM (SELECT 1) """.replace("FROM s)", "FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT 1))").replace("FROM s WHERE", "FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0 UNION ALL SELECT 1) WHERE"),
    "exact_cover": """SELECT count(*) FILTER (WHERE b.k IS NULL) AS missing, count(*) FILTER (WHERE a.k IS NULL) AS unexpected, count(*) FILTER (WHERE a.n > 1) AS repeated_left, count(*) FILTER (WHERE b.n > 1) AS repeated_right
        FROM (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k""",
    "cohort_errors": """SELECT cohort, count(*) AS n, sum((quality <> toxic)::INT)::BIGINT AS errors, avg((quality = toxic)::INT) AS accuracy FROM (SELECT labels.*, unnest(list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 2000 THEN 'long' END, 'all'], lambda x: x IS NOT NULL)) AS cohort
        FROM labels LEFT JOIN documents USING (doc_id)) GROUP BY cohort""",
    "amount_bands": "SELECT CASE WHEN amount < 0 OR amount > 10000 THEN NULL WHEN amount <= 5 THEN 0 WHEN amount <= 10 THEN 1 WHEN amount <= 20 THEN 2 WHEN amount <= 50 THEN 3 WHEN amount <= 100 THEN 4 WHEN amount <= 200 THEN 5 WHEN amount <= 500 THEN 6 WHEN amount <= 1000 THEN 7 ELSE 8 END::BIGINT AS band, count(*) AS n, min(tx_id) AS first_id FROM led GROUP BY 1",
    "qcut_chi2": f"""SELECT sum((coalesce(n, 0) - na * nb / total) ^ 2 / (na * nb / total)) AS chi2, ((count(DISTINCT a.bin) - 1) * (count(DISTINCT b.type) - 1))::BIGINT AS df FROM (SELECT bin, count(*) AS na FROM ({QUARTILE}) GROUP BY 1) a
        CROSS JOIN (SELECT type, count(*) AS nb FROM ({QUARTILE}) GROUP BY 1) b CROSS JOIN (SELECT count(*) AS total FROM led) LEFT JOIN (SELECT bin, type, count(*) AS n FROM ({QUARTILE}) GROUP BY ALL) c ON a.bin = c.bin AND b.type = c.type""",
    "rank_auc": "SELECT (sum(CASE WHEN q = 1 THEN r END) - sum(q) * (sum(q) + 1) / 2) / (sum(q) * (count(*) - sum(q))) AS auc FROM (SELECT quality AS q, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id))",
    "calendar_parts": """SELECT tx_id, hour(timestamp) AS h, minute(timestamp) AS mi, isodow(timestamp) - 1 AS wd, day(timestamp) AS dom, strftime(timestamp, '%Y-%m') AS ym, strftime(timestamp + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS nm,
        strftime(timestamp + to_days(CASE isodow(timestamp) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END), '%Y-%m-%d %H:%M:%S') AS bd FROM led""",
    "orders_by_priority_cube": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)",
    "order_streams": f"""SELECT client_id, count(*) AS n, count(DISTINCT comp) AS components FROM (SELECT *, count(*) OVER (PARTITION BY client_id, comp) AS size FROM (SELECT *, sum(brk) OVER (PARTITION BY client_id ORDER BY amount, tx_id ROWS UNBOUNDED PRECEDING) AS comp FROM
        (SELECT o_custkey AS client_id, o_orderkey AS tx_id, o_totalprice AS amount, CASE WHEN ln(o_totalprice) - lag(ln(o_totalprice)) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) > {EPS} THEN 1 ELSE 0 END AS brk FROM orders))) WHERE size >= 2 GROUP BY client_id""",
    "html_links": r"""SELECT href, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, trim(unnest(regexp_extract_all(html, '(?i)href\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1)), chr(34) || chr(39)) AS href FROM pages) GROUP BY href""",
    "fold_assignment": "SELECT quality, fold, count(*) AS n FROM (SELECT quality, (row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1) % 5 AS fold FROM labels) GROUP BY ALL",
}

MERCHANTS = sorted({x for f in FAMILIES for x in TEMPLATES[f]})
_CARD = "type IN ('card_payment', 'refund')"


def masked(key: str, rate: float, seed: int) -> tuple[str, str]:
    """Condition and text of masked descriptions."""
    hit = f"({_CARD} AND NOT regexp_matches(txt, '{BACKGROUND}') AND txt NOT IN ({texts(GENERIC)}) AND {drawn(key, seed)} / 4294967296.0::DOUBLE < {rate})"
    return hit, f"CASE WHEN {hit} THEN {chosen(GENERIC, key, seed + 1)} ELSE description END"


def corrupted(scenario: str, seed: int = 2026) -> str:
    r1, r2, r3, r4 = CORRUPTION[scenario]
    key = "history, content"
    below = lambda salt, r: f"{drawn(key, salt)} / 4294967296.0::DOUBLE < {r}"
    back = f"regexp_matches(txt, '{BACKGROUND}')"
    text = f"CASE WHEN {_CARD} AND {back} AND {below(seed + 3, r3)} THEN {chosen(MERCHANTS, key, seed + 7)} ELSE {masked(key, r1, seed)[1]} END"
    swap = "CASE mcc " + " ".join(f"WHEN '{m}' THEN {chosen(o, key, seed + 8)}" for m, o in CONFUSED.items()) + " END"
    return f"""SELECT tx_id, CASE WHEN {_CARD} AND {below(seed + 4, r4)} THEN {chosen(PREFIX_NOISE, key, seed + 5)} || x || {chosen(SUFFIX_NOISE, key, seed + 6)} ELSE x END AS description,
        CASE WHEN {_CARD} AND NOT {back} AND {below(seed + 2, r2)} AND mcc IN ({texts(CONFUSED)}) THEN {swap} ELSE mcc END AS mcc FROM (SELECT *, {text} AS x FROM keyed)"""


def blocks_sql(columns: str) -> str:
    return f"SELECT client_id, block, {columns} FROM blkg GROUP BY client_id, block"


def macro(prediction: str) -> str:
    share = lambda x: f"(sum(w) FILTER (WHERE truth = '{x}'))"
    zero = lambda e: f"coalesce({e}, 0)"
    f1 = [
        f"coalesce(2 * {zero(f"sum(w) FILTER (WHERE truth = '{x}' AND {prediction} = '{x}')")} / nullif({zero(share(x))} + {zero(f"(sum(w) FILTER (WHERE {prediction} = '{x}'))")}, 0), 0)"
        for x in ("0", "1", "2")
    ]
    return "(" + " + ".join(f1) + ") / 3"


_POISSON = " + ".join(f"(u >= {s})::INT" for s in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582))
_SUMMED = "count(*) AS count, avg(amount) AS amount_mean, stddev_pop(amount) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max, median(amount) AS amount_median, -min(t) AS first_age, -max(t) AS last_age, max(t) - min(t) AS span, count(DISTINCT mcc) AS unique_mcc, avg(gap) AS gap_mean, max(gap) AS gap_max, median(abs(gap - 30)) AS period_error_30"
_BLOCKS = ["global", "card", *(f"mcc{m}" for m in sorted(set(MCC.values()))), "generic", *(f"{k}_{f}" for f in FAMILIES for k in ("text", "joint"))]
_VOCABULARY = {"type": ["card_payment", "topup", "p2p_transfer", "transfer", "atm", "refund", "fee"], "direction": ["out", "in"], "currency": ["chf", "eur", "usd", "gbp"]}
_COUNTED = lambda p: ", ".join(f"count(*) FILTER (WHERE {c} = '{v}') AS {p}{c}_{v}" for c, vs in _VOCABULARY.items() for v in vs)
_CONTEXT = ["last_fee", "refund_count", "refund_count90", "refund_count30", "fee_fraction", "fee_mean", "hour_std", "weekend_fraction", "refund_ratio", "refund_last_age", "refund_after_last"]
_RANKED = ["amount0_next_median", "amount0_last_age", "amount0_count", "amount0_own_template_diversity", "broad0_next_median", "broad0_count", "broad0_own_template_diversity"]
_GLOBAL = ["amount0_next_active", "amount0_active", "amount0_count", "amount0_last_age", "amount0_amount_cv", "amount0_own_semantic", "broad0_active", "broad0_count", "broad0_next_active", "amount0_gap_cv", "amount0_linear_next"]
_CLOCKS = [f"{s}_{c}" for s in SLOTS for c in ("clock_period", "clock_next", "clock_active_next", "clock_strength", "clock_active", "next_modulo")]
_CELLS = "SELECT *, regexp_split_to_array(document, '[^a-z0-9_]+') AS w0 FROM docs"
_WORDS = f"SELECT client_id, list_filter(w0, lambda x: length(x) > 1) AS w FROM ({_CELLS})"
_TERMS = f"SELECT client_id, unnest(list_concat(w, [w[k] || ' ' || w[k + 1] for k in range(1, length(w))])) AS term FROM ({_WORDS})"
_CHARS = "SELECT client_id, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i::INT, n))) AS term FROM (SELECT client_id, ' ' || unnest(list_filter(string_split(trim(regexp_replace(document, '[^a-z]+', ' ', 'g')), ' '), lambda x: x <> '')) || ' ' AS p FROM docs), (VALUES (3), (4), (5)) AS v(n) WHERE length(p) >= n"


def tfidf(terms: str) -> str:
    return f"""SELECT client_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY client_id)) AS weight FROM (SELECT client_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(DISTINCT client_id) FROM docs)) / (1 + df)) + 1) AS v
        FROM (SELECT client_id, term, count(*) AS n FROM ({terms}) GROUP BY ALL) JOIN (SELECT term, count(DISTINCT client_id) AS df, count(*) AS total FROM ({terms}) GROUP BY term HAVING count(DISTINCT client_id) >= 2 ORDER BY total DESC, term LIMIT 30000) USING (term))"""


# template evidence on canonical texts
BODIES_TC = CTES["tc"].replace("FROM co JOIN tem ON txt = template", f"FROM (SELECT co.* REPLACE (canonical AS txt) FROM co JOIN ({CANON}) USING (tx_id)) JOIN tem ON txt = template")
BODIES |= {
    "semi_filter": "SELECT tx_id, client_id FROM led WHERE client_id IN (SELECT client_id FROM led WHERE type = 'refund')",
    "derived_keys": "SELECT txt || ' | ' || mcc AS description_mcc, type || ' | ' || mcc AS type_mcc, count(*) AS n FROM led GROUP BY ALL",
    "renamed_clients": f"SELECT CASE WHEN {NUMBER} % 2 = 0 THEN 'R' || reverse(client_id) ELSE client_id END AS client_id, tx_id FROM led",
    "describe_all": "SELECT count(amount) AS n, avg(amount) AS mean, stddev_samp(amount) AS std, min(amount) AS min, max(amount) AS max, " + ", ".join(f"quantile_cont(amount, {q / 100}) AS q{q}" for q in (1, 10, 50, 90, 99)) + " FROM led",
    "grouped_report": "SELECT family, e.s AS statistic, count(e.v) AS n, avg(e.v) AS mean, median(e.v) AS median, stddev_samp(e.v) AS std FROM (SELECT family, unnest(["
    + ", ".join(f"{{'s': '{c}', 'v': {c}::DOUBLE}}" for c in ("count", "last_age", "span", "gap_median", "gap_cv")) + "]) AS e FROM stf) GROUP BY family, e.s",
    "unstacked_families": "SELECT client_id, " + ", ".join(f"max(CASE WHEN family = '{f}' THEN {c} END) AS {n}__{f}" for c, n in (("stream_count", "stream_count"), ("b_count", "broad0_count")) for f in LABELS) + " FROM mat GROUP BY client_id",
    "date_parts": "SELECT tx_id, second(timestamp) AS s, minute(timestamp) AS mi, hour(timestamp) AS h, day(timestamp) AS day, month(timestamp) AS month, isodow(timestamp) - 1 AS wd, epoch_us(timestamp) + 92 * 86400000000 AS shifted FROM led",
    "repeated_texts": """SELECT *, CASE WHEN count > 16 THEN 4 WHEN count > 8 THEN 3 WHEN count > 4 THEN 2 WHEN count > 2 THEN 1 WHEN count > 1 THEN 0 END::BIGINT AS occurrence_band,
        CASE WHEN recency_days > 180 THEN 5 WHEN recency_days > 90 THEN 4 WHEN recency_days > 60 THEN 3 WHEN recency_days > 30 THEN 2 WHEN recency_days > 15 THEN 1 WHEN recency_days > 0 THEN 0 END::BIGINT AS recency_band,
        CASE WHEN median_interval_days > 200 THEN 6 WHEN median_interval_days > 100 THEN 5 WHEN median_interval_days > 65 THEN 4 WHEN median_interval_days > 35 THEN 3 WHEN median_interval_days > 20 THEN 2 WHEN median_interval_days > 10 THEN 1 WHEN median_interval_days > 0 THEN 0 END::BIGINT AS interval_band,
        CASE WHEN interval_cv > 1 THEN 4 WHEN interval_cv > 0.5 THEN 3 WHEN interval_cv > 0.25 THEN 2 WHEN interval_cv > 0.1 THEN 1 WHEN interval_cv > -0.001 THEN 0 END::BIGINT AS regularity_band
        FROM (SELECT *, interval_std_days / greatest(median_interval_days, 0.01) AS interval_cv FROM (SELECT client_id, txt, count(*) AS count, -max(t) AS recency_days, max(t) - min(t) AS span_days, median(gap) AS median_interval_days,
          stddev_pop(gap) AS interval_std_days, avg(amount) AS amount_mean, stddev_pop(amount) AS amount_std FROM (SELECT *, t - lag(t) OVER (PARTITION BY client_id, txt ORDER BY t, tx_id) AS gap FROM co) GROUP BY client_id, txt HAVING count(*) >= 2))""",
    "row_json": "SELECT tx_id, to_json({'client_id': client_id, 'type': type, 'mcc': mcc, 'txt': txt})::VARCHAR AS json FROM led",
    "first_rows": "SELECT client_id, tx_id, amount, txt FROM led QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY timestamp, tx_id) = 1",
    "total_order": "SELECT tx_id, row_number() OVER (ORDER BY timestamp, client_id, amount, tx_id) AS position FROM led",
    "recipe_selection": "SELECT recipe, macro AS score, complexity, position FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS recipe, round(sum(coalesce(2.0 * h / nullif(t + p, 0), 0)) / 8, 9) AS macro, {1 + k % 2}::BIGINT AS complexity, {k}::BIGINT AS position FROM (SELECT lab.family, count(*) FILTER (WHERE label = lab.family) AS t, count(*) FILTER (WHERE prediction = lab.family) AS p, count(*) FILTER (WHERE label = lab.family AND prediction = lab.family) AS h FROM lab, (SELECT r.prediction, y.label FROM ({rule(o)}) r JOIN ({WEAK}) y USING (client_id)) GROUP BY lab.family)"
        for k, (n, o) in enumerate({"most_frequent": "count DESC", "most_recent": "last_age", "minimum_next": "greatest(next_median, 0)", "regularity": "gap_cv"}.items())) + ") QUALIFY row_number() OVER (ORDER BY score DESC, complexity, position) = 1",
    "best_examples": "SELECT doc_id AS client_id, truth, prediction, confidence FROM (SELECT *, (doc_id * 37 % 100) / 100 AS confidence FROM pairs WHERE truth = prediction) QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY confidence DESC, doc_id) = 1",
    "top_confusions": "SELECT truth, prediction, count(*) AS n FROM pairs WHERE truth <> prediction GROUP BY ALL ORDER BY n DESC, truth, prediction LIMIT 20",
    "client_sample": "SELECT client_id FROM ids ORDER BY md5(concat_ws('|', client_id, 7)), client_id LIMIT 20",
    "fold_membership": "SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY md5(concat_ws('|', doc_id, 42)), doc_id) - 1) % 5 AS fold FROM labels",
    "permuted_labels": """SELECT a.doc_id, b.quality FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, 5)), doc_id) AS n FROM labels) a
        JOIN (SELECT quality, row_number() OVER (ORDER BY md5(concat_ws('|', doc_id, 6)), doc_id) AS n FROM labels) b USING (n)""",
    "history_fingerprint": "SELECT client_id, history FROM hist",
    "masked_rows": f"SELECT tx_id, {masked('tx_id', 0.3, 7)[1]} AS description, {masked('tx_id', 0.3, 7)[0]} AS masked FROM led",
    "masked_view": f"SELECT type, count(*) AS n, count(*) FILTER (WHERE {masked('tx_id', 0.3, 7)[0]}) AS masked FROM led GROUP BY type",
    "corrupted_rows_valid_like": corrupted("valid_like"),
    "corrupted_rows_test_like": corrupted("test_like"),
    "corrupted_view": f"SELECT mcc, count(*) AS n FROM ({corrupted('valid_like')}) GROUP BY mcc",
    "bootstrap_ci": f"""SELECT m.k AS metric, quantile_cont(m.v, 0.025) AS low, quantile_cont(m.v, 0.975) AS high FROM (SELECT unnest([{{'k': 'accuracy', 'v': a}}, {{'k': 'macro_f1', 'v': f}}, {{'k': 'rival_macro_f1', 'v': g}}, {{'k': 'delta', 'v': f - g}}]) AS m FROM
        (SELECT replicate, sum(w) FILTER (WHERE truth = prediction) / sum(w) AS a, {macro('prediction')} AS f, {macro('rival')} AS g FROM
          (SELECT *, {_POISSON} AS w FROM (SELECT *, {drawn('doc_id, replicate', 20260925)} / 4294967296.0::DOUBLE AS u FROM (SELECT *, (doc_id % 2)::VARCHAR AS rival FROM pairs), (SELECT unnest(range(2000)) AS replicate))) GROUP BY replicate)) GROUP BY m.k""",
    "ensemble": f"""SELECT client_id, family, family_index, m * pow((family_index + 1) / 36, -0.25) / sum(m * pow((family_index + 1) / 36, -0.25)) OVER (PARTITION BY client_id) AS p FROM
        (SELECT client_id, family, family_index, 0.75 * avg(q) + 0.25 * any_value(l) AS m FROM (SELECT *, CASE WHEN family = 'none' THEN pn ELSE p * (1 - pn) / sum(CASE WHEN family <> 'none' THEN p END) OVER (PARTITION BY client_id, seed) END AS q FROM
          (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY client_id, seed) AS p, exp(o) / sum(exp(o)) OVER (PARTITION BY client_id, seed) AS l, CASE seed WHEN 1 THEN {NUMBER} % 10 / 20 + 0.1 ELSE 0.3 END AS pn FROM
            (SELECT *, coalesce(CASE seed WHEN 1 THEN stream_count ELSE b_count END, 0) / 4 / 1.5 AS s, coalesce(b_count, 0) / 8 / 1.5 AS o FROM mat, (VALUES (1), (2)) AS v(seed)))) GROUP BY ALL)""",
    "raw_ensemble": """SELECT client_id, family, family_index, exp(s) / sum(exp(s)) OVER (PARTITION BY client_id) AS p FROM
        (SELECT *, (0.5 * (coalesce(stream_count, 0) / 4 + coalesce(b_count, 0) / 4) / 2 + 0.5 * coalesce(b_count, 0) / 8) / 1.5 AS s FROM mat)""",
    "rank_auc_by_language": "SELECT lang, (sum(CASE WHEN q = 1 THEN r END) - sum(q) * (sum(q) + 1) / 2) / nullif(sum(q) * (count(*) - sum(q)), 0) AS auc FROM (SELECT lang, quality AS q, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)) GROUP BY lang",
    "split_profile": "SELECT count(*) AS transactions, count(DISTINCT client_id) AS clients, epoch_us(min(timestamp)) AS first, epoch_us(max(timestamp)) AS last, count(DISTINCT description) AS descriptions, count(*) - (SELECT count(*) FROM (SELECT DISTINCT client_id, timestamp, amount, currency, type, direction, description, mcc, fee FROM led)) AS repeated FROM led",
    "description_structure": "SELECT txt, mcc, type, direction, count(amount) AS n, round(avg(amount) + 1e-9, 4) AS mean, stddev_samp(amount) AS std, min(amount) AS min, median(amount) AS q50, max(amount) AS max FROM led GROUP BY ALL",
    "official_score": f"""SELECT avg(coalesce(2 * h / nullif(s + q, 0), 0)) AS macro_f1, sum(h) / sum(s) AS accuracy FROM (SELECT family, count(*) FILTER (WHERE truth = family) AS s, count(*) FILTER (WHERE said = family) AS q, count(*) FILTER (WHERE truth = family AND said = family) AS h
        FROM lab, (SELECT {label_at(1)} AS truth, CASE WHEN {NUMBER} % 3 = 0 THEN {label_at(1)} ELSE {label_at(5)} END AS said FROM ids) GROUP BY family)""",
    "aligned_targets": f"SELECT client_id, {NUMBER} * 3 % 8 AS y FROM ids",
    "sample_order": f"SELECT client_id, ({NUMBER} * 7919) % 100003 AS position, {label_at(1)} AS prediction FROM ids",
    "documents_raw": "SELECT client_id, string_agg(description, ' ; ' ORDER BY timestamp, tx_id, description) AS document FROM led GROUP BY client_id",
    "documents_enriched": "SELECT client_id, string_agg(concat(txt, ' mcc', mcc, ' type', type, ' ', replace(txt, ' ', '_'), '_m', mcc), ' ; ' ORDER BY timestamp, tx_id) AS document FROM led GROUP BY client_id",
    "tfidf_weights": tfidf(_TERMS),
    "tfidf_characters": tfidf(_CHARS),
    "tabular_blocks": f"SELECT * REPLACE (round(amount_mean + 1e-9, 4) AS amount_mean) FROM ({blocks_sql(_SUMMED)})",
    "tabular_wide": "SELECT * FROM (SELECT client_id, " + ", ".join(f"{f'coalesce(max(CASE WHEN block = {chr(39)}{b}{chr(39)} THEN {c} END), 0)' if c == 'count' else f'max(CASE WHEN block = {chr(39)}{b}{chr(39)} THEN {c} END)'} AS {b}__{c}" for b in _BLOCKS for c in ("count", "amount_median", "gap_median"))
    + f" FROM ({blocks_sql('count(*) AS count, median(amount) AS amount_median, median(gap) AS gap_median')}) GROUP BY client_id) JOIN (SELECT client_id, {_COUNTED('global__')}, " + per_family(lambda f: f"count(*) FILTER (WHERE direction = 'in' AND regexp_matches(txt, '{PATTERNS[f]}')) AS text_{f}__refund_count") + " FROM led GROUP BY client_id) USING (client_id)",
    "edge_values": "SELECT client_id, family, coalesce(a_count, -999) AS amount0_count, coalesce(b_gap, -999) AS broad0_gap_median, b_gap AS broad0_gap_known FROM mat",
    "ablation_columns": "SELECT client_id, family, NULL::DOUBLE AS unknown, stream_count, b_count AS broad0_count, b1_age AS broad1_last_age FROM mat LEFT JOIN (SELECT client_id, candidate AS family, last_age AS b1_age FROM top WHERE kind = 'broad' AND rank = 1) USING (client_id, family)",
    "view_union": 'SELECT client_id, family, stream_count, CASE v WHEN 0 THEN b_count END AS broad0_count, v AS "view", 0.5::DOUBLE AS weight FROM mat, (VALUES (0), (1)) AS x(v)',
    "page_words": r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS text FROM pages",
    "clock_selection": f"SELECT client_id, family, {', '.join(_CLOCKS)} FROM ({clocks('top')})",
    **{f"matrix_{s}": f"SELECT client_id, family, {', '.join(f'{s}_{c}' for c in COMPACT)} FROM fm" for s in SLOTS},
    "matrix_templates": f"SELECT client_id, family, stream_count, {', '.join(f'own_template_{c}' for c in TEMPLATE_STATS)} FROM fm",
    "matrix_ranks": "SELECT client_id, family, " + ", ".join(
        f"coalesce(CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY client_id ORDER BY {c} {'DESC' if down else 'ASC'} NULLS LAST) END, 8) AS {c}_rank, {c} - {'max' if down else 'min'}({c}) OVER (PARTITION BY client_id) AS {c}_vs_best"
        for c in _RANKED for down in ["count" in c or "diversity" in c]) + " FROM fm",
    "matrix_activity": "SELECT client_id, family, " + ", ".join(f"{p}_{c}" for p in ("amount0", "broad0", "amount1") for c in ("active", "next_active", "period_rounded", *(f"{x}_per_event" for x in ("own_semantic", "own_mcc", "own_template_diversity", "own_template_count")))) + " FROM fa",
    "matrix_competition": "SELECT client_id, family, " + ", ".join(map(compared, _GLOBAL)) + " FROM fa",
    "matrix_globals": f"SELECT cand.client_id, family, g.* EXCLUDE (client_id) FROM cand JOIN (SELECT client_id, count(*) AS client_total_count, avg(amount) AS client_amount_mean, coalesce(stddev_samp(amount), 0) AS client_amount_std, max(-t) AS client_first_age, min(-t) AS client_last_age, {_COUNTED('client_')}, "
    + ", ".join(f"count(*) FILTER (WHERE -t <= {w}) AS client_count_{w}" for w in TEST_WINDOWS) + " FROM led GROUP BY client_id) g USING (client_id)",
    "matrix_context": "SELECT client_id, family, " + ", ".join(f"max(CASE WHEN prefix = '{p}' THEN {c} END) AS {p}_{c}" for p in ("amount0", "broad0") for c in _CONTEXT) + " FROM cand LEFT JOIN ctx USING (client_id, family) GROUP BY client_id, family",
    "ranking_matrix": f"SELECT client_id, family, {', '.join(c for c in _CLOCKS if 'active_next' not in c)}, {', '.join(f'coalesce(global_none_{c}, 0) AS global_none_{c}' for c in TEMPLATE_STATS)} FROM ({clocks('tops')}) LEFT JOIN (SELECT client_id, {', '.join(f'own_template_{c} AS global_none_{c}' for c in TEMPLATE_STATS)} FROM tw WHERE family = 'none') USING (client_id)",
    "ranking_competition": "SELECT client_id, family, " + ", ".join(
        map(compared, [*(f"{s}_{c}" for s in SLOTS for c in ("clock_active_next", "next_modulo", "last_age", "clock_active")), *(f"own_template_{c}" for c in TEMPLATE_STATS if c.startswith("mcc_999")), "amount0_count", "amount0_gap_cv", "amount0_linear_next", "broad0_next_median", "broad0_count"])
    ) + f" FROM ({clocks('tops')}) JOIN (SELECT * EXCLUDE ({', '.join(f'{s}_last_age' for s in SLOTS)}) FROM fm) USING (client_id, family)",
}


def first_gains(gradients: str, enough: str, l2: float = 10.0) -> str:
    """All splits of the root over sixteen bins, from gradients ``(client_id, i, g, h)`` in whole units."""
    named = ["stream_count", "b_count", "b_gap", "family_index"]
    features = "[" + ", ".join(f"{{'f': '{n}', 'v': {c}::DOUBLE}}" for n, c in zip(["stream_count", "broad0_count", "broad0_gap_median", "family_index"], named)) + "]"
    return f"""SELECT f AS feature, bin, gl * gl / (hl + {l2}) + (g - gl) ^ 2 / (h - hl + {l2}) - g * g / (h + {l2}) AS gain, g, h, n, gl, hl, nl FROM
      (SELECT f, bin, sum(g) OVER u / 1048576 AS gl, sum(h) OVER u / 1048576 AS hl, (sum(n) OVER u)::BIGINT AS nl, sum(g) OVER w / 1048576 AS g, sum(h) OVER w / 1048576 AS h, (sum(n) OVER w)::BIGINT AS n FROM
        (SELECT f, bin, sum(round(g * 1048576)) AS g, sum(round(h * 1048576)) AS h, count(*) AS n FROM
          (SELECT e.client_id, e.i, e.f, CASE WHEN any_value(v) IS NULL THEN 0 ELSE 1 + count(c) END::BIGINT AS bin FROM (SELECT client_id, family_index AS i, unnest({features}, recursive := true) FROM mat) e
            LEFT JOIN (SELECT DISTINCT f, v AS c FROM (SELECT f, v, row_number() OVER (PARTITION BY f ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY f) AS n FROM (SELECT unnest({features}, recursive := true) FROM mat) WHERE v IS NOT NULL)
              JOIN range(1, 16) k ON r = floor(k.range * n / 16)) c ON c.f = e.f AND c.c < e.v GROUP BY ALL)
          JOIN ({gradients}) USING (client_id, i) GROUP BY ALL)
        WINDOW u AS (PARTITION BY f ORDER BY bin), w AS (PARTITION BY f)) WHERE {enough}"""


_LISTS = f"SELECT client_id, family_index AS i, (family = label)::INT AS y FROM cand JOIN ({WEAK}) USING (client_id)"
# no scores yet: a member's place is its rank, both ends of a pair are equally likely
_LAMBDAS = f"""SELECT client_id, i, sum(g) * k AS g, sum(h) * k AS h FROM (SELECT client_id, unnest([{{'i': a, 'g': -w / 2, 'h': w / 4}}, {{'i': b, 'g': w / 2, 'h': w / 4}}], recursive := true) FROM
      (SELECT x.client_id, x.i AS a, z.i AS b, abs(1 / log2(2 + x.i) - 1 / log2(2 + z.i)) AS w FROM ({_LISTS}) x JOIN ({_LISTS}) z ON x.client_id = z.client_id AND x.y > z.y))
    JOIN (SELECT client_id, log2(1 + sum(w)) / sum(w) AS k FROM (SELECT x.client_id, abs(1 / log2(2 + x.i) - 1 / log2(2 + z.i)) AS w FROM ({_LISTS}) x JOIN ({_LISTS}) z ON x.client_id = z.client_id AND x.y > z.y) GROUP BY 1) USING (client_id)
    GROUP BY client_id, i, k"""


def mixed(x: str) -> str:
    """The finalizer of SplitMix64 on a number below 2**64, as HUGEINT halves."""
    times = lambda a, c: f"((({a}) & 4294967295)::HUGEINT * {c}::HUGEINT + (((({a}) >> 32)::HUGEINT * {c}::HUGEINT) & 4294967295::HUGEINT) * 4294967296::HUGEINT) & 18446744073709551615::HUGEINT"
    one = f"list_transform([{x}], lambda q: {times('xor(q, q >> 30)', 13787848793156543929)})"
    two = f"list_transform({one}, lambda q: {times('xor(q, q >> 27)', 10723151780598845931)})"
    return f"list_transform({two}, lambda q: xor(q, q >> 31))[1]"


# the first round: its salt is 0; partners are the members of other labels in label order
_PAIRS = f"""SELECT client_id, i, sum(g) AS g, sum(h) AS h FROM (SELECT client_id, unnest([{{'i': a, 'g': s / 8, 'h': 0.125}}, {{'i': b, 'g': -s / 8, 'h': 0.125}}], recursive := true) FROM
      (SELECT client_id, a, CASE y WHEN 1 THEN -1 ELSE 1 END AS s, others[({mixed('base + a * 4 + k + 1')} % len(others) + 1)::INT] AS b FROM
        (SELECT x.client_id, x.i AS a, x.y, list(z.i ORDER BY z.i) FILTER (WHERE z.y <> x.y) AS others, {mixed("('0x' || substr(md5(x.client_id), 1, 15))::HUGEINT")} AS base FROM ({_LISTS}) x JOIN ({_LISTS}) z USING (client_id) GROUP BY ALL),
        (SELECT range AS k FROM range(4)) WHERE others IS NOT NULL)) GROUP BY client_id, i"""
_TEXT_OF = lambda when: f"(SELECT client_id, string_agg(txt, ' ; ' ORDER BY timestamp, tx_id, txt) AS document FROM led WHERE t {when} GROUP BY client_id)"
_EARLY, _LATE = (_TERMS.replace("docs", _TEXT_OF(when)) for when in ("< -15", ">= -15"))
_TRIALS = "SELECT (2 * k + s)::INT AS trial, list_transform(range(8), lambda j: (CASE WHEN j = k THEN d ELSE 0 END) - d / 8) AS bias FROM (SELECT range AS k FROM range(8)), (VALUES (0, -0.2::DOUBLE), (1, 0.2::DOUBLE)) AS v(s, d)"
_SETS = " UNION ALL ".join(f"SELECT {k} AS part, client_id, list(ln(greatest(round(p, 6), 1e-12)) ORDER BY family_index) AS l FROM ({BODIES[n]}) GROUP BY client_id" for k, n in enumerate(("ensemble", "raw_ensemble")))
BODIES |= {
    "listwise_round": first_gains(_LAMBDAS, "least(nl, n - nl) >= 5 AND least(hl, h - hl) >= 0.001"),
    "pairwise_round": first_gains(_PAIRS, "least(nl, n - nl) >= 1 AND least(hl, h - hl) >= 10"),
    "target_encoding": f"""SELECT doc_id, (coalesce(sum((quality = 0)::INT) OVER b, 0) + 0.5) / (coalesce(count(*) OVER b, 0) + 1) AS lang_ts_0, (coalesce(sum((quality = 1)::INT) OVER b, 0) + 0.5) / (coalesce(count(*) OVER b, 0) + 1) AS lang_ts_1
        FROM labels JOIN documents USING (doc_id) WINDOW b AS (PARTITION BY lang ORDER BY {drawn('doc_id', 42)}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "bias_trials": f"""SELECT trial::BIGINT AS trial, avg(m) AS score FROM (SELECT trial, part, sum(f) / 8 AS m FROM (SELECT trial, part, label, 2.0 * sum((y = guess)::INT) FILTER (WHERE side = 0) / count(*) AS f FROM
        (SELECT trial, part, y, guess, unnest([y, guess]) AS label, unnest([0, 1]) AS side FROM (SELECT trial, part, list_position([{texts(LABELS)}], {label_at(3)}) - 1 AS y,
          list_transform([list_transform(range(1, 9), lambda j: l[j] + bias[j])], lambda s: list_position(s, list_max(s)) - 1)[1] AS guess FROM ({_SETS}), ({_TRIALS}))) GROUP BY ALL) GROUP BY ALL) GROUP BY trial""",
    "template_canonical": BODIES_TC,
    "tfidf_vectors": f"""SELECT client_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY client_id)) AS weight FROM (SELECT client_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM {_TEXT_OF('< -15')})) / (1 + df)) + 1) AS v
        FROM (SELECT client_id, term, count(*) AS n FROM ({_LATE}) GROUP BY ALL) JOIN (SELECT term, count(DISTINCT client_id) AS df, count(*) AS total FROM ({_EARLY}) GROUP BY term HAVING count(DISTINCT client_id) >= 2 ORDER BY total DESC, term LIMIT 200) USING (term))""",
    "invariance_rename": """SELECT client_id, '' AS "column" FROM ids WHERE false""",
    "invariance_shuffle": """SELECT client_id, family, scope, "window", '' AS "column" FROM ro WHERE false""",
    "invariance_poison": f"""SELECT client_id, unnest(list_filter(['largest', CASE WHEN count(*) <> count(*) FILTER (WHERE fee > 0) THEN 'fees' END], lambda x: x IS NOT NULL)) AS "column" FROM led WHERE {NUMBER} % 10 = 3 GROUP BY client_id""",
    "stream_stats_rest": f"""SELECT {GAP_KEYS}, min(amount) AS amount_min, max(amount) AS amount_max, max(ms) AS mcc_top_fraction, stddev_pop(day(timestamp)) AS dom_std, stddev_pop(isodow(timestamp)) AS dow_std,
        CASE WHEN count(*) >= 2 THEN max(t) + avg(gap) END AS next_mean, CASE WHEN count(*) >= 2 THEN max(t) + arg_max(gap, i) END AS next_last, CASE WHEN count(*) >= 2 THEN -max(t) / greatest(median(gap), 1) END AS overdue_ratio, """
    + ", ".join(f"avg(regexp_matches(txt, '{PATTERNS[f]}')::INT) AS semantic_{f}, avg((mcc = '{MCC[f]}')::INT) AS mcc_{f}, count(DISTINCT txt) FILTER (WHERE txt IN ({texts(TEMPLATES[f])})) AS template_{f}_diversity, count(*) FILTER (WHERE txt IN ({texts(TEMPLATES[f])})) AS template_{f}_count" for f in FAMILIES)
    + f" FROM (SELECT *, count(*) OVER (PARTITION BY {GAP_KEYS}, mcc) / count(*) OVER (PARTITION BY {GAP_KEYS}) AS ms FROM m1) GROUP BY {GAP_KEYS}",
}
_COMPARED = "count amount_cv last_age span unique_description description_top_fraction description_entropy gap_median gap_std gap_cv generic_fraction".split()
_CLUSTERS = f"""(SELECT st0.*, label AS target, family = label AS matches_target, descriptions, mcc_mode FROM (SELECT *, amount_std / amount_mean AS amount_cv FROM stf WHERE group_type = 'amount') st0 JOIN ({WEAK}) USING (client_id)
    JOIN (SELECT client_id, currency, comp, string_agg(txt, ' | ' ORDER BY n DESC, txt) AS descriptions FROM (SELECT client_id, currency, comp, txt, count(*) AS n FROM chains WHERE size >= 3 GROUP BY ALL) GROUP BY ALL) USING (client_id, currency, comp)
    JOIN (SELECT client_id, currency, comp, arg_min(mcc, (-n, mcc)) AS mcc_mode FROM (SELECT client_id, currency, comp, mcc, count(*) AS n FROM chains WHERE size >= 3 GROUP BY ALL) GROUP BY ALL) USING (client_id, currency, comp))"""
_JUDGED = f"(SELECT client_id, label AS truth, prediction, round(confidence, 9) AS confidence FROM (SELECT client_id, arg_max(family, (p, -family_index)) AS prediction, max(p) AS confidence FROM probs GROUP BY client_id) JOIN ({WEAK}) USING (client_id))"
_OWN = f"""(SELECT *, truth <> 'none' AS fam_, truth <> 'none' AND c >= 3 AS cand_ FROM (SELECT j.*, total, coalesce(amount0_count, -1) AS c, coalesce(amount0_last_age, -1) AS age, coalesce(amount0_gap_cv, -1) AS cv
    FROM {_JUDGED} j JOIN (SELECT client_id, count(*) AS total FROM led GROUP BY client_id) USING (client_id) LEFT JOIN fm ON fm.client_id = j.client_id AND fm.family = truth))"""
_COHORTS = {
    "all": "true", "low_history": "total < 20", "high_activity": "total > 30", "true_none": "NOT fam_", "true_family": "fam_", "family_without_candidate": "fam_ AND c < 3",
    "family_regular": "cand_ AND cv BETWEEN 0 AND 0.25", "family_irregular": "cand_ AND cv > 0.25", "family_recent": "cand_ AND age BETWEEN 0 AND 45", "family_stale": "cand_ AND age > 90",
}
_PICKED = lambda c: f"CASE evidence WHEN 'amount0' THEN amount0_{c} WHEN 'broad0' THEN broad0_{c} END AS {c}"
BODIES |= {
    "json_rows_parsed": "SELECT tx_id, client_id, epoch_us(timestamp) AS at_us, amount, type, mcc, description, fee FROM led",
    "forensic_clusters": f"SELECT client_id, currency, comp, target, descriptions, mcc_mode, family, matches_target, {', '.join(_COMPARED)} FROM {_CLUSTERS}",
    "forensic_report": f"SELECT matches_target, statistic, count(value) AS n, round(avg(value) + 1e-9, 6) AS mean, median(value) AS median FROM (UNPIVOT (SELECT matches_target, {', '.join(f'{c}::DOUBLE AS {c}' for c in _COMPARED)} FROM {_CLUSTERS}) ON {', '.join(_COMPARED)} INTO NAME statistic VALUE value) GROUP BY ALL",
    "forensic_intervals": f"SELECT round_even(gap_median, 0)::BIGINT AS days, count(*) AS n FROM {_CLUSTERS} GROUP BY days ORDER BY n DESC, days LIMIT 20",
    "forensic_texts": f"""SELECT client_id, txt, any_value(label) AS target, count(*) AS count, median(amount) AS amount_median, count(DISTINCT description) AS unique_description, avg(-ln(share)) AS description_entropy, avg((fee > 0)::INT) AS fee_fraction,
        count(DISTINCT strftime(timestamp, '%Y-%m')) AS month_count, any_value(gm) AS gap_median, median(abs(gap - gm)) AS gap_mad, max(t) + any_value(gm) AS next_median, arg_max(gap, (t, tx_id)) AS gap_last
        FROM (SELECT *, median(gap) OVER (PARTITION BY client_id, txt) AS gm FROM (SELECT *, t - lag(t) OVER (PARTITION BY client_id, txt ORDER BY t, tx_id) AS gap, count(*) OVER (PARTITION BY client_id, txt, description) / count(*) OVER (PARTITION BY client_id, txt) AS share FROM co))
        JOIN ({WEAK}) USING (client_id) GROUP BY client_id, txt HAVING count(*) >= 3""",
    "error_cohorts": " UNION ALL ".join(f"SELECT '{k}' AS cohort, count(*) AS n, count(*) FILTER (WHERE truth <> prediction) AS errors, avg((truth = prediction)::INT) AS accuracy FROM {_OWN} WHERE {w}" for k, w in _COHORTS.items()),
    "error_kinds": f"SELECT count(*) FILTER (WHERE truth <> prediction) AS errors, count(*) FILTER (WHERE truth <> 'none' AND prediction = 'none') AS missed, count(*) FILTER (WHERE truth = 'none' AND prediction <> 'none') AS invented, count(*) FILTER (WHERE truth <> prediction AND truth <> 'none' AND prediction <> 'none') AS wrong_family FROM {_JUDGED}",
    "explanations": f"""SELECT client_id, prediction AS label, confidence, evidence, available, {', '.join(map(_PICKED, ('count', 'gap_median', 'last_age', 'amount_median', 'refund_count')))} FROM
        (SELECT *, CASE WHEN prediction = 'none' THEN NULL WHEN amount0_count >= 3 THEN 'amount0' WHEN broad0_count > 0 THEN 'broad0' END AS evidence FROM
          (SELECT * FROM {_JUDGED} WHERE truth = prediction QUALIFY row_number() OVER (PARTITION BY prediction ORDER BY confidence DESC, client_id) = 1) b JOIN (SELECT client_id, family AS prediction, {', '.join(f'{s}_{c}' for s in ('amount0', 'broad0') for c in ('count', 'gap_median', 'last_age', 'amount_median'))} FROM fm) USING (client_id, prediction)
          LEFT JOIN (SELECT client_id, family AS prediction, {', '.join(f"max(CASE WHEN prefix = '{p}' THEN refund_count END) AS {p}_refund_count" for p in ('amount0', 'broad0'))} FROM ctx GROUP BY ALL) USING (client_id, prediction)
          JOIN (SELECT client_id, count(*) FILTER (WHERE family <> 'none' AND amount0_count >= 3) AS available FROM fm GROUP BY client_id) USING (client_id))""",
}
ORACLE_SQL = {k: sql(v) for k, v in BODIES.items()}
# its own WITH clause follows the shared expressions
_HEAD = sql("SELECT 1 FROM quiet").rsplit("\n", 1)[0]
ORACLE_SQL["cadence_audit"] = f"{_HEAD},\n{CADENCE.removeprefix('WITH ')}"
ORACLE_SQL["forecast_errors"] = (
    f"SELECT e.k AS forecast, count(e.v) AS n, avg(e.v) AS mean_error, median(e.v) AS median_error FROM (SELECT unnest([{{'k': 'median_interval', 'v': median_interval}}, {{'k': 'same_day', 'v': same_day}}, {{'k': 'business_day', 'v': business_day}}]) AS e FROM ({ORACLE_SQL['cadence_audit']})) GROUP BY e.k"
)
