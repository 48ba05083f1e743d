"""The registered queries of this subpackage and, where SQL has them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, licenses, mixing, quality, quality_rules, sharding, simhash, toxicity, urlfilter
from .common import held_out_remainder

SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, held_out_remainder(F.col("doc_id"), 5) != 0)
    rows = quality.score(docs, model)
    held = held_out_remainder(F.col("doc_id"), 5) == 0
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_hex("fp").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("broken", F.array_join("broken", ","))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_row")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, held_out_remainder(F.col("doc_id"), 4) != 2)
    rows = toxicity.score(docs, model)
    held = held_out_remainder(F.col("doc_id"), 4) == 2
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents")).drop("spans")


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html": op1_html,
        "op2_mix": op2_mix,
        "op3_quality": op3_quality,
        "op4_simhash": op4_simhash,
        "op5_quality_rules": op5_quality_rules,
        "op6_decontaminate": op6_decontaminate,
        "op7_toxicity": op7_toxicity,
        "op8_licenses": op8_licenses,
        "op9_shard": op9_shard,
        "op10_url_filter": op10_url_filter,
    }


_MIX = """
WITH rows AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS size,
    CAST('0x' || substr(md5(concat_ws('|', '11', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''))), 1, 15) AS BIGINT) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * CAST(sum(size) AS DOUBLE) AS most,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight FROM rows GROUP BY source),
filled AS (SELECT *, coalesce(sum(most) OVER up, 0) + most AS used, (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER up, 0) - weight AS open,
    lead(most / weight) OVER (ORDER BY most / weight, source) AS next, most / weight AS ratio
    FROM sources WINDOW up AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
total AS (SELECT 1.5::DOUBLE * CAST(sum(source_size) AS DOUBLE) AS t, sum(weight) AS w FROM sources),
levels AS (SELECT t / w AS level, min(ratio) AS next, 0 AS k FROM total, filled GROUP BY t, w
    UNION ALL SELECT (t - used) / open, next, row_number() OVER (ORDER BY ratio, source) FROM filled, total WHERE open > 0),
level AS (SELECT level FROM levels WHERE next > level OR next IS NULL ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(most, weight * level) AS target FROM sources, level),
cut AS (SELECT *, CAST(round(target) AS BIGINT) AS budget FROM targets),
runs AS (SELECT r.doc_id, r.size, c.source_size, c.target, CASE WHEN c.source_size > 0 THEN c.budget // c.source_size ELSE 0 END AS epochs,
    CASE WHEN c.source_size > 0 THEN c.budget % c.source_size ELSE 0 END AS rest,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM rows r JOIN cut c ON r.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM runs
"""

_SLOT = " ".join(f"WHEN t IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in decontaminate.SLOTS.items())
_CANON = f"CASE WHEN ascii(t) < 58 THEN '#number' {_SLOT} ELSE t END"
_NAMED = "ascii(t) BETWEEN 65 AND 90 AND NOT ascii(substr(t, 2, 1)) BETWEEN 65 AND 90"

_LEAKS = f"""
WITH texts AS (SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT DISTINCT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
split AS (SELECT side, id, md5(text) AS row, regexp_extract_all(text, '\\d+(?:[.,]\\d+)*|[\\p{{L}}\\p{{M}}]+') AS raw FROM texts),
low AS (SELECT *, list_transform(raw, lambda t: lower(t)) AS said FROM split),
plain AS (SELECT *, list_transform(said, lambda t: {_CANON}) AS kinds FROM low),
formed AS (SELECT *, list_transform(raw, lambda t, i: CASE WHEN {_NAMED} THEN '#name' ELSE kinds[i] END) AS names FROM plain),
iread AS (SELECT id, said, kinds, false AS formed FROM formed WHERE side = 'i' UNION ALL SELECT id, said, names, true FROM formed WHERE side = 'i'),
iv AS (SELECT * FROM (SELECT id, said, formed, kinds, i, array_to_string(kinds[i:i + 4], ' ') AS w, len(list_filter(kinds[i:i + 4], lambda t: starts_with(t, '#'))) AS slots
    FROM iread, unnest(range(1, len(kinds) - 3)) u(i)) WHERE 5 - slots >= 3),
sizes AS (SELECT id AS item_id, formed, count(DISTINCT w) AS n_windows FROM iv GROUP BY ALL),
spread AS (SELECT id, row, kinds, names, unnest(range(1, len(kinds) - 3)) AS i FROM formed WHERE side = 'd'),
dw AS (SELECT DISTINCT id, row, i, w FROM (SELECT id, row, i, array_to_string(kinds[i:i + 4], ' ') AS w FROM spread UNION ALL SELECT id, row, i, array_to_string(names[i:i + 4], ' ') FROM spread)
    WHERE w IN (SELECT w FROM iv)),
hits AS (SELECT dw.id AS doc_id, dw.row, iv.id AS item_id, iv.formed, w, iv.slots, dw.i AS di, iv.i AS ii, l.said AS ds, iv.said AS s, iv.kinds
    FROM dw JOIN iv USING (w) JOIN (SELECT * FROM low WHERE side = 'd') l ON dw.id IS NOT DISTINCT FROM l.id AND dw.row = l.row),
found AS (SELECT doc_id, row, item_id, formed, count(DISTINCT w) AS n_hits FROM hits GROUP BY ALL),
slots AS (SELECT doc_id, row, item_id, formed, shift, a, b, count(*) AS n FROM (SELECT DISTINCT doc_id, row, item_id, formed, di - ii AS shift, ii + k AS place, s[ii + k] AS a, ds[di + k] AS b
    FROM hits, unnest(range(0, 5)) u(k) WHERE slots > 0 AND starts_with(kinds[ii + k], '#')) GROUP BY ALL),
kept AS (SELECT doc_id, row, item_id, formed, shift, a, sum(n) AS every, max(n) AS same, bool_or(a <> b) AS other FROM slots GROUP BY ALL),
agreed AS (SELECT doc_id, row, item_id, formed, CAST(sum(every) AS BIGINT) AS n_slots, sum(same)::DOUBLE / sum(every)::DOUBLE AS agreement, bool_or(other) AS other FROM kept GROUP BY ALL)
SELECT f.doc_id, f.item_id, n_windows, n_hits, n_hits / n_windows AS containment, coalesce(n_slots, 0) AS n_slots, coalesce(agreement, 1.0::DOUBLE) AS slot_agreement, coalesce(other, false) AS reparameterised
FROM found f JOIN sizes USING (item_id, formed) LEFT JOIN agreed g ON f.doc_id IS NOT DISTINCT FROM g.doc_id AND f.row = g.row AND f.item_id = g.item_id AND f.formed = g.formed
WHERE n_hits / n_windows >= {decontaminate.CONTAINMENT} AND coalesce(agreement, 1) >= {decontaminate.AGREEMENT}
QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.row, f.item_id ORDER BY n_hits / n_windows DESC, f.formed) = 1
"""


_RISK = quality_rules.Risk()
_SHARES = {n: e.replace(" / ", "::DOUBLE / ") for n, e in quality_rules.STATISTICS.items()}
_ALPHA = _RISK.alpha / len(_SHARES)

_RULES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS s FROM w, unnest(range(1, len(words) - 3)) u(i)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) u(k) GROUP BY r),
lines AS (SELECT r, l FROM d, unnest(string_split(text, chr(10))) u(l) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
counted AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
f AS (SELECT d.r, doc_id, stratum, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(text) - length(translate(text, '{quality_rules.SYMBOLS}', '')) AS n_symbols, coalesce(counted.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, length(text) - length(translate(text, '{quality_rules.UPPER}', '')) AS n_upper, length(text) - length(translate(text, '!', '')) AS n_bang
    FROM d JOIN w USING (r) LEFT JOIN covered USING (r) LEFT JOIN counted USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, [{", ".join(_SHARES.values())}] AS shares FROM f),
marks AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
held AS (SELECT stratum, good, shares FROM b JOIN marks USING (doc_id) WHERE NOT base_failed),
ladder AS (SELECT unnest(range(0, {len(quality_rules.LADDER)})) AS rung, unnest({list(quality_rules.LADDER)}::DOUBLE[]) AS c),
tested AS (SELECT stratum, j, rung, c, count(*) FILTER (good = 1) AS n, count(*) FILTER (good = 1 AND shares[j] > c) AS k, count(*) FILTER (good <> 1 AND shares[j] > c) AS caught
    FROM held, unnest(range(1, {len(_SHARES) + 1})) u(j), ladder GROUP BY ALL),
tails AS (SELECT *, CASE WHEN k >= n * {_ALPHA}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k + 1),
    lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA}::DOUBLE) + (n - i) * ln(1 - {_ALPHA}::DOUBLE)))) END AS tail FROM tested),
walked AS (SELECT *, max(CASE WHEN tail > {_RISK.delta}::DOUBLE / greatest(1, (SELECT count(DISTINCT stratum) FROM held) * {len(_SHARES)}) THEN 1 ELSE 0 END)
    OVER (PARTITION BY stratum, j ORDER BY rung) AS fails, caught - {_RISK.cost} * k AS worth FROM tails),
best AS (SELECT stratum, j, c FROM walked WHERE fails = 0 AND worth > 0 QUALIFY row_number() OVER (PARTITION BY stratum, j ORDER BY worth DESC, rung) = 1),
broken AS (SELECT r, list(({list(_SHARES)})[j] ORDER BY j) AS broken FROM b JOIN best USING (stratum) WHERE shares[j] > c GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken IS NULL AS kept, coalesce(array_to_string(broken, ','), '') AS broken
FROM b LEFT JOIN broken USING (r)
"""


#: Where pages mark their article, the main text is all text in it.
_PAGES = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|\z)', 1), '<[^>]*>', ' ', 'g') AS plain FROM pages),
u AS (SELECT page_id, url, regexp_replace(replace(replace(replace(replace(plain, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;?', '&', 'g') AS plain FROM a),
t AS (SELECT page_id, url, trim(regexp_replace(plain, '\s+', ' ', 'g')) AS text FROM u)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = [(n, licenses.pattern(m), n.endswith(licenses.MENTIONS)) for n, m in licenses.TEMPLATES.items()]

_LICENSES = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
j AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM w),
phrases AS (SELECT unnest([{", ".join(f"{{'said': {p.split()}, 'label': {_text(n)}}}" for p, n in licenses.PHRASES)}], recursive := true)),
places AS (SELECT r, label, i - 1 AS place FROM j, phrases, unnest(range(1, len(words) - len(said) + 2)) u(i) WHERE contains(line, ' ' || array_to_string(said, ' ') || ' ') AND words[i:i + len(said) - 1] = said),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS labels FROM places GROUP BY r),
found AS (SELECT r, list_filter([{", ".join(f"CASE WHEN regexp_matches(line, {_text(' ' + p)}) THEN {_text(n)} END" for n, p, _ in _TEMPLATES)}], lambda x: x IS NOT NULL) AS names FROM j
    WHERE regexp_matches(line, 'licen|permi|cc by|all rights|redistri|gnu |creative commons|cc0|free |warrant'))
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
    array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(names, [])))), ',') AS labels,
    CASE WHEN len(list_filter(coalesce(names, []), lambda x: x NOT IN ({", ".join(_text(n) for n, _, mention in _TEMPLATES if mention)}))) > 0 THEN 1.0::DOUBLE
        WHEN len(coalesce(names, [])) > 0 THEN 0.75::DOUBLE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM j LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


def _simhash_sql() -> str:
    """XXH64 of every shingle in 128-bit arithmetic, majority bits, all pairs of different fingerprints, reachability."""
    p1, p2, p3, p4, p5 = (f"{x}::UHUGEINT" for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m, seed = "18446744073709551616::UHUGEINT", simhash.SEED

    def turn(x: str, bits: int) -> str:
        return f"(({x}) * {1 << bits}::UHUGEINT % {m} + ({x}) // {1 << 64 - bits}::UHUGEINT)"

    def lane(at: str, n: int) -> str:
        return " + ".join(f"b[{at} + {i + 1}] * {1 << 8 * i}::UHUGEINT" for i in range(n))

    def step(k: str, bits: int, mul: str, add: str) -> str:
        return f"{{'h': 0::UHUGEINT, 'k': ({k}) % {m}, 'up': {1 << bits}::UHUGEINT, 'down': {1 << 64 - bits}::UHUGEINT, 'mul': {mul}, 'add': {add}}}"

    starts = [(seed + 11400714785074694791 + 14029467366897019727) % (1 << 64), seed + 14029467366897019727, seed, (seed - 11400714785074694791) % (1 << 64)]
    four = ", ".join(
        f"list_reduce(list_transform(range(0, n // 32), lambda t: q[4 * t + {j + 1}]), lambda v, x: {turn(f'(v + x) % {m}', 31)} * {p1} % {m}, {x}::UHUGEINT) AS v{j}" for j, x in enumerate(starts)
    )
    merged = " + ".join(turn(f"v{j}", bits) for j, bits in enumerate((1, 7, 12, 18)))
    rounds = ", ".join(f"{turn(f'v{j} * {p2} % {m}', 31)} * {p1} % {m}" for j in range(4))
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {i}) & 1) > count(*) THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END" for i in range(64))
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT r, array_to_string(words[i:i + 3], ' ') AS said FROM w, unnest(range(1, greatest(1, len(words) - 3) + 1)) u(i) WHERE len(words) > 0),
d AS (SELECT said, strlen(said) AS n, hex(encode(said)) AS x FROM (SELECT DISTINCT said FROM s)),
b AS (SELECT said, n, list_transform(range(0, n), lambda k: ('0x' || substr(x, CAST(2 * k + 1 AS BIGINT), 2))::UHUGEINT) AS b FROM d),
l AS (SELECT said, n, b, list_transform(range(0, n // 8), lambda t: ({lane("8 * t", 8)}) * {p2} % {m}) AS q, n // 8 * 8 AS e FROM b),
v AS (SELECT said, n, b, q, e, {four} FROM l),
o AS (SELECT *, ((CASE WHEN n < 32 THEN {seed}::UHUGEINT + {p5} ELSE list_reduce([{rounds}], lambda h, k: (xor(h, k) * {p1} + {p4}) % {m}, ({merged}) % {m}) END) + n::UHUGEINT) % {m} AS h0,
    list_concat(list_transform(q[4 * (n // 32) + 1:], lambda x: {step(f"{turn('x', 31)} * {p1}", 27, p1, p4)}),
        CASE WHEN n % 8 >= 4 THEN [{step(f"({lane('e', 4)}) * {p1}", 23, p2, p3)}] ELSE [] END,
        list_transform(b[e + CASE WHEN n % 8 >= 4 THEN 4 ELSE 0 END + 1:], lambda x: {step(f"x * {p5}", 11, p1, "0::UHUGEINT")})) AS steps FROM v),
f AS (SELECT said, list_reduce(steps, lambda a, s: {{'h': ((xor(a.h, s.k) * s.up % {m} + xor(a.h, s.k) // s.down) * s.mul + s.add) % {m}, 'k': 0::UHUGEINT, 'up': 0::UHUGEINT, 'down': 0::UHUGEINT, 'mul': 0::UHUGEINT, 'add': 0::UHUGEINT}},
    {{'h': h0, 'k': 0::UHUGEINT, 'up': 0::UHUGEINT, 'down': 0::UHUGEINT, 'mul': 0::UHUGEINT, 'add': 0::UHUGEINT}}).h AS h FROM o),
a1 AS (SELECT said, xor(h, h // {1 << 33}::UHUGEINT) * {p2} % {m} AS h FROM f),
a2 AS (SELECT said, xor(h, h // {1 << 29}::UHUGEINT) * {p3} % {m} AS h FROM a1),
a3 AS (SELECT said, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM a2),
p AS (SELECT r, ({bits})::UBIGINT AS fp FROM s JOIN a3 USING (said) GROUP BY r),
docs AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN p USING (r)),
least_id AS (SELECT fp, min(doc_id) AS id FROM docs GROUP BY fp),
near AS (SELECT x.fp AS a, y.fp AS b FROM least_id x JOIN least_id y ON x.fp <> y.fp AND bit_count(xor(x.fp, y.fp)) <= {simhash.RADIUS}),
reach AS (SELECT fp, fp AS other FROM least_id UNION SELECT reach.fp, near.b FROM reach JOIN near ON reach.other = near.a),
named AS (SELECT reach.fp, min(id) AS component_id FROM reach JOIN least_id ON reach.other = least_id.fp GROUP BY reach.fp)
SELECT doc_id, lower(lpad(to_hex(fp), 16, '0')) AS fingerprint, component_id FROM docs JOIN named USING (fp)
"""


_SIMHASH = _simhash_sql()

_SEED = 20240229
_KEYS = [int(k) for k in sharding.Feistel(1, _SEED)._keys()]

_SHARDS = f"""
WITH RECURSIVE steps AS (SELECT unnest(range(0, 256)) AS i, unnest(range(0, 256)) AS c, 0 AS k
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
effects AS (SELECT list(c ORDER BY i) AS effect FROM steps WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text, substr(md5(concat_ws('|', '{_SEED}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 16) AS h FROM documents),
b AS (SELECT doc_id, h, strlen(text) + 1 AS size, list_transform(range(0, strlen(text)), lambda k: ('0x' || substr(hex(encode(text)), CAST(2 * k + 1 AS BIGINT), 2))::BIGINT) AS bytes FROM d),
c AS (SELECT doc_id, h, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, effect[1 + (xor(c, x) & 255)]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM b, effects),
m AS (SELECT n, 1::UBIGINT << half AS top, half FROM (SELECT n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2)::UBIGINT AS half FROM (SELECT count(*)::UBIGINT AS n FROM documents))),
rows AS (SELECT *, (row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size, crc) - 1)::UBIGINT AS num FROM c),
walk AS (SELECT num, num // top AS l, num % top AS r, 0 AS k FROM rows, m
    UNION ALL SELECT num, CASE WHEN k = {len(_KEYS)} THEN l ELSE r END, CASE WHEN k = {len(_KEYS)} THEN r ELSE xor(l, xor(z2, z2 >> 32) % top) END, CASE WHEN k = {len(_KEYS)} THEN 0 ELSE k + 1 END
    FROM (SELECT *, ((xor(z1, z1 >> 29)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z2
        FROM (SELECT num, l, r, k, top, n, (((r::UHUGEINT + coalesce([{", ".join(f"{k}::UHUGEINT" for k in _KEYS)}][k + 1], 0::UHUGEINT)) * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z1
            FROM walk, m WHERE k < {len(_KEYS)} OR l * top + r >= n))),
placed AS (SELECT num, l * top + r AS p FROM walk, m WHERE k = {len(_KEYS)} AND l * top + r < n)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, (p % {SHARDS})::INT AS shard, (p // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard FROM rows JOIN placed USING (num)
"""


def _url_models(strings: str, models: str, name: str) -> str:
    """Steps from {strings} (shape, accepted, rejected, weight, fold) to {name}scored (shape, score): each scored by the models of
    its fold, which leave the fold out, or by the only one, -1."""
    own = "m.m = s.fold" if models == "range(0, 5)" else "true"
    return f"""
{name}models AS (SELECT unnest({models}) AS m),
{name}grams AS (SELECT shape, fold, accepted, rejected, weight, substr(p, greatest(1, i - 4), i - greatest(1, i - 4)) AS context, substr(p, i, 1) AS ch
    FROM (SELECT *, '^' || shape || '$' AS p FROM {strings}), unnest(range(2, length(p) + 1)) u(i)),
{name}counts AS (SELECT m, right(context, k) AS key, ch, sum(CASE WHEN accepted THEN weight ELSE 0 END) AS a, sum(CASE WHEN rejected THEN weight ELSE 0 END) AS r
    FROM {name}grams, {name}models, unnest(range(0, length(context) + 1)) u(k) WHERE fold <> m GROUP BY ALL),
{name}totals AS (SELECT m, key, sum(a) AS an, sum((a > 0)::INT) AS kinds_a, sum(r) AS rn, sum((r > 0)::INT) AS kinds_r FROM {name}counts GROUP BY ALL),
{name}path AS (SELECT w.m, w.context, w.ch, list([coalesce(c.a, 0)::DOUBLE, t.an::DOUBLE, t.kinds_a::DOUBLE] ORDER BY w.k) AS va, list([coalesce(c.r, 0)::DOUBLE, t.rn::DOUBLE, t.kinds_r::DOUBLE] ORDER BY w.k) AS vr
    FROM (SELECT m, context, ch, k, right(context, k) AS key FROM (SELECT DISTINCT m, context, ch FROM {name}grams, {name}models), unnest(range(0, length(context) + 1)) u(k)) w
    JOIN {name}totals t ON t.m = w.m AND t.key = w.key LEFT JOIN {name}counts c ON c.m = w.m AND c.key = w.key AND c.ch = w.ch GROUP BY ALL),
{name}ratios AS (SELECT m, context, ch, ln(list_reduce(vr, lambda p, s: [CASE WHEN s[2] > 0 THEN (s[1] + 1000 * s[3] * p[1]) / (s[2] + 1000 * s[3]) ELSE p[1] END], [1::DOUBLE / 64])[1])
    - ln(list_reduce(va, lambda p, s: [CASE WHEN s[2] > 0 THEN (s[1] + 1000 * s[3] * p[1]) / (s[2] + 1000 * s[3]) ELSE p[1] END], [1::DOUBLE / 64])[1]) AS ratio FROM {name}path),
{name}scored AS (SELECT s.shape, round(avg(m.ratio), 9) AS score FROM {name}grams s JOIN {name}ratios m ON {own} AND m.context = s.context AND m.ch = s.ch GROUP BY s.shape)"""


_FIT = "(host = {h} OR ends_with(host, {dot})) AND starts_with(path, {p})"
_RULE = " ".join(
    f"WHEN {_FIT.format(h=_text(h), dot=_text('.' + h), p=_text(p))} THEN {{'rule': {_text(h + p)}, 'kind': {_text(k)}}}" for k, h, p in sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
)

_URLS = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_replace(lower(url), '\d+', '0', 'g') AS shape FROM u),
ruled AS (SELECT *, CASE {_RULE} END AS rule, len(list_intersect(regexp_split_to_array(host, '[.\-_\d]+'), {list(urlfilter.SEEDS)})) > 0 AS marked,
    regexp_replace(host, '^(?:{"|".join(urlfilter.FRONTS)})\.', '') AS site FROM v),
strings AS (SELECT shape, round(ln(1 + count(*)) * 1000)::BIGINT AS weight, bool_or(marked) AS rejected, bool_or(NOT marked AND coalesce(rule.kind = 'allow', true)) AS accepted,
    (('0x' || substr(md5(min(site)), 1, 8))::BIGINT % 5)::INT AS fold FROM ruled GROUP BY shape),{_url_models("strings", "range(0, 5)", "a_")},
apart AS (SELECT * FROM strings JOIN a_scored USING (shape)),
losses AS (SELECT t, count(*) FILTER (accepted AND NOT rejected AND score > t) / count(*) FILTER (accepted AND NOT rejected) + count(*) FILTER (rejected AND score <= t) / count(*) FILTER (rejected) AS loss
    FROM apart, unnest({list(urlfilter.GRID)}::DOUBLE[]) g(t) GROUP BY t),
limits AS (SELECT min(t) AS t FROM losses WHERE loss <= (SELECT min(loss) FROM losses) + {urlfilter.NOISE}::DOUBLE),
mended AS (SELECT shape, weight, fold, rejected OR (accepted AND score > t) AS rejected, accepted AND NOT (rejected OR score > t) AS accepted FROM apart, limits),{_url_models("mended", "[-1]", "b_")}
SELECT page_id, host, path, rule.rule AS rule, coalesce(rule.kind, CASE WHEN score > t THEN 'block' ELSE 'allow' END) AS verdict, round(score, 6) AS score
FROM ruled JOIN b_scored USING (shape), limits
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_html": _PAGES, "op2_mix": _MIX, "op4_simhash": _SIMHASH, "op5_quality_rules": _RULES, "op6_decontaminate": _LEAKS, "op8_licenses": _LICENSES, "op9_shard": _SHARDS, "op10_url_filter": _URLS}
