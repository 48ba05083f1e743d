"""Benchmark decontamination by template canonicalisation, with DataFrame operations alone.

Texts become tokens (runs of letters, and numbers); numbers, names and units become typed placeholders, in two readings: the
plain one knows names by a list, whatever their case, the other takes every token for a name that begins with one capital
A-Z. The hashes of all five-token windows of the documents, in both readings, are joined with those of the benchmark items.
A document leaks an item if, in one reading, it has at least 0.8 of the item's windows and if the placeholders stand
consistently: along a run of matching windows each value of the item is always replaced by the same value of the document.
So a question with other numbers or names is caught, and texts that only share a pattern of placeholders are not. Items
without a window of three words that are no placeholders, and those of fewer than five tokens, are looked for by their
literal tokens.

Of an item's n windows a leak lacks at most n - ceil(0.8 n), so it has one at least of any n - ceil(0.8 n) + 1 of them: only so
many, those that the fewest items share, are joined with the windows of all documents. What they find is then verified with
all windows of the item, by document, so a window that is common in the documents is never paired with them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, checkpoint, fresh, text_or_empty

WINDOW = 5
CONTAINMENT = 0.8
AGREEMENT = 0.8
#: A window needs so many tokens that are no placeholders.
LITERAL = 3
#: An item of fewer than WINDOW tokens and fewer bytes than this says too little: only a document of just its tokens leaks it.
BRIEF = 12
TOKEN = r"\d+(?:[.,]\d+)*|[\p{L}\p{M}]+"

#: Number words, units and given names, lower case, of English, German, French and Spanish. Fixed values.
NUMBERS = (
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig "
    "dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend "
    "deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille "
    "dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta "
    "ochenta noventa cien mil"
).split()
UNITS = (
    "km cm mm kg mg ml lb lbs oz ft mph kph kwh khz mhz ghz kb mb gb tb meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters mile miles inch inches feet yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cents euro euros percent degree degrees watt watts volt volts joule joules newton newtons "
    "sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre grad prozent pfund meile meilen "
    "mètre mètres seconde secondes heure heures jour jours semaine semaines mois année années degré degrés litre "
    "metro metros kilómetro kilómetros segundo segundos minuto minutos hora horas día días semana semanas meses año años grado grados"
).split()
NAMES = (
    "alice anna bob carlos carol charlie daniel david elena emily emma eric fatima george hannah isabella jack james jane jennifer "
    "jessica john jose joseph julia karen kevin laura linda lisa liam lucy maria mary michael mike mohammed nancy natalia noah oliver "
    "olivia patricia paul peter rachel robert samuel sandra sara sarah sofia sophia steven susan thomas tom tyler victoria william "
    "yusuf zoe"
).split()
SLOTS = {"#number": NUMBERS, "#unit": UNITS, "#name": NAMES}


def tokens(text: Column) -> Column:
    """Numbers and runs of letters, as they stand; none for null."""
    return F.regexp_extract_all(text_or_empty(text), F.lit(TOKEN), F.lit(0))


def canonical(token: Column) -> Column:
    """A lower-case token, or the placeholder that stands for it."""
    kind = F.lit(None).cast("string")
    for name, words in SLOTS.items():
        kind = F.when(token.isin(words), name).otherwise(kind)
    special = [w for words in SLOTS.values() for w in words]
    return F.when(F.ascii(token) < 58, "#number").when(token.isin(special), kind).otherwise(token)


def named(token: Column) -> Column:
    """Whether a token has the form of a name: one capital A-Z, and what follows is no capital A-Z."""
    return F.ascii(token).between(65, 90) & ~F.ascii(F.substring(token, 2, 1)).between(65, 90)


def readings(token: Column) -> tuple[Column, Column]:
    """A token as the two readings have it."""
    plain = canonical(F.lower(token))
    return plain, F.when(named(token), "#name").otherwise(plain)


def _hashed(rows: DataFrame, literal: bool = False) -> DataFrame:
    """rows with _plain (hashes of the tokens in the plain reading, or of the lower-case tokens if literal) and _formed."""
    rows = rows.withColumn("_plain", F.transform("_tokens", lambda t: F.xxhash64(F.lower(t) if literal else canonical(F.lower(t)))))
    name = F.xxhash64(F.lit("#name"))
    return rows.withColumn("_formed", F.col("_plain") if literal else F.transform("_tokens", lambda t, i: F.when(named(t), name).otherwise(F.col("_plain")[i])))


def window_keys(rows: DataFrame, size: int = WINDOW, literal: bool = False) -> DataFrame:
    """rows, without _tokens, with a row for each window and each different hash of it: _at and _key.

    The token hashes are made once for each text; the window hashes are made from them after the positions are dealt out,
    inside generated code, so that no array is copied for each window.
    """
    rows = _hashed(rows, literal).drop("_tokens")
    # an empty sequence for texts of fewer tokens: no row
    last = F.size("_plain") - size
    spread = rows.withColumn("_at", F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    plain, formed = (F.xxhash64(*[F.col(c)[F.col("_at") + k] for k in range(size)]) for c in ("_plain", "_formed"))
    spread = spread.withColumn("_p", plain).withColumn("_f", plain if literal else formed).drop("_plain", "_formed")
    return spread.withColumn("_key", F.explode(F.when(F.col("_p") == F.col("_f"), F.array("_p")).otherwise(F.array("_p", "_f")))).drop("_p", "_f")


def _values(tokens: str) -> Column:
    """Hashes of lower-case tokens: what placeholders are compared by."""
    return F.transform(tokens, lambda t: F.xxhash64(F.lower(t)))


def _item_tokens(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), tokens(F.col(text_col)).alias("_tokens"))


def item_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, formed (the reading), _key, _item_at, _said (the tokens' hashes), _kinds (as the reading has them), _slots (how
    many are placeholders), n_windows (distinct ones of the item in this reading).

    Windows of placeholders alone, or nearly, are left out; literal_windows has the items that have no other, and those of
    fewer than five tokens.
    """
    rows = _item_tokens(benchmark, item_col, text_col)
    parts = []
    for formed in (False, True):
        kinds = F.transform("_tokens", lambda t: readings(t)[formed])  # noqa: B023  read at once
        spread = rows.select("item_id", _values("_tokens").alias("_low"), kinds.alias("_all")).withColumn("_item_at", F.explode(F.when(F.size("_low") >= WINDOW, F.sequence(F.lit(0), F.size("_low") - WINDOW))))
        spread = spread.select("item_id", "_item_at", *[F.slice(c, F.col("_item_at") + 1, WINDOW).alias(n) for c, n in (("_low", "_said"), ("_all", "_kinds"))])
        key = F.xxhash64(*[F.xxhash64(F.col("_kinds")[k]) for k in range(WINDOW)])
        part = spread.select("item_id", F.lit(formed).alias("formed"), key.alias("_key"), "_item_at", "_said", "_kinds")
        parts.append(part.withColumn("_slots", F.size(F.filter("_kinds", lambda t: F.startswith(t, F.lit("#"))))).filter(WINDOW - F.col("_slots") >= LITERAL))
    cut = parts[0].unionByName(parts[1])
    sizes = cut.groupBy("item_id", "formed").agg(F.countDistinct("_key").alias("n_windows"))
    return checkpoint(cut.distinct().join(sizes, ["item_id", "formed"]))


def rare_windows(items: DataFrame) -> DataFrame:
    """item_id and _key of the windows that a leak cannot all lack: the rarest n - ceil(CONTAINMENT n) + 1 of each item."""
    keys = items.select("item_id", "formed", "_key", "n_windows").distinct()
    shared = keys.join(keys.groupBy("_key").agg(F.count(F.lit(1)).alias("_items")), "_key")
    rank = F.row_number().over(Window.partitionBy("item_id", "formed").orderBy("_items", "_key"))
    return shared.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("n_windows") - F.ceil(F.col("n_windows") * CONTAINMENT - 1e-9) + 1).select("item_id", "_key").distinct()


def literal_windows(benchmark: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each item that has no row in items: item_id, _key (of a window of literal tokens, WINDOW or all that the item has),
    _size (tokens of the window), _brief, n_windows."""
    rows = _item_tokens(benchmark, item_col, text_col)
    rows = rows.join(items.select("item_id").distinct(), "item_id", "left_anti").withColumn("_size", F.least(F.size("_tokens"), F.lit(WINDOW)))
    rows = rows.withColumn("_brief", (F.col("_size") < WINDOW) & (F.octet_length(F.array_join("_tokens", "")) < BRIEF))
    cut = [window_keys(rows.filter(F.col("_size") == n), n, literal=True).select("item_id", "_key", "_size", "_brief") for n in range(1, WINDOW + 1)]
    cut = reduce(DataFrame.unionByName, cut).distinct()
    return checkpoint(cut.join(cut.groupBy("item_id").agg(F.countDistinct("_key").alias("n_windows")), "item_id"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: doc_id, _row (hash of the text), item_id, n_windows, n_hits,
    containment, n_slots, slot_agreement, reparameterised; of the reading with the larger containment, the plain one first.

    Null and empty texts leak nothing, nor is anything found of items with null ids or without tokens. Items without usable
    windows have no placeholders: n_slots is 0. Null and repeated ids are told apart by their texts; equal rows count as one.
    Texts of any length are read whole; empty tables give no rows; other columns are not read.
    """
    items = item_windows(benchmark)
    rare = checkpoint(rare_windows(items))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_row"), tokens(F.col(text_col)).alias("_tokens"))
    pairs = checkpoint(window_keys(rows).join(broadcast_if_small(rare, rare.count()), "_key").select("doc_id", "_row", "item_id").distinct())
    suspects = pairs.select(F.col("doc_id").alias("_d"), F.col("_row").alias("_r")).distinct()
    # the texts of the suspects alone are taken apart again
    own = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_row"), F.col(text_col).alias("_text"))
    own = own.join(broadcast_if_small(suspects, suspects.count()), _same_text("_d", "_r"), "left_semi").dropDuplicates(["doc_id", "_row"])
    own = checkpoint(own.select("doc_id", "_row", tokens(F.col("_text")).alias("_tokens")))
    n_items = items.count()
    theirs = window_keys(own).join(broadcast_if_small(items.select("_key").distinct(), n_items), "_key", "left_semi")
    # only keys are dealt out by document; what the windows say is looked up for those that match
    narrow = items.select("item_id", "formed", "n_windows", "_key", "_item_at", "_slots")
    wanted = pairs.join(broadcast_if_small(narrow, n_items), "item_id").withColumnsRenamed({"doc_id": "_d", "_row": "_r", "_key": "_k"})
    hits = theirs.join(wanted, _same_text("_d", "_r") & (F.col("_key") == F.col("_k")))
    hits = hits.join(broadcast_if_small(items.select("item_id", "formed", "_key", "_item_at", "_said", "_kinds"), n_items), ["item_id", "formed", "_key", "_item_at"])
    told = own.select(F.col("doc_id").alias("_td"), F.col("_row").alias("_tr"), _values("_tokens").alias("_all"))
    hits = hits.join(told, _same_text("_td", "_tr")).withColumn("_says", F.when(F.col("_slots") > 0, F.slice("_all", F.col("_at") + 1, WINDOW)))
    hits = hits.select("doc_id", "_row", "item_id", "formed", "n_windows", "_key", "_item_at", "_at", "_slots", *[F.when(F.col("_slots") > 0, F.col(c)).alias(c) for c in ("_said", "_kinds")], "_says")
    literal = literal_windows(benchmark, items)
    for r in literal.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect():  # WINDOW rows at most
        short = literal.filter(F.col("_size") == r["_size"])
        same = window_keys(rows.withColumn("_n", F.size("_tokens")), r["_size"], literal=True)
        same = same.join(broadcast_if_small(short, r["n"]), "_key").filter(~F.col("_brief") | (F.col("_n") == r["_size"]))
        none = [F.lit(False).alias("formed"), F.lit(0).alias("_item_at"), F.lit(0).alias("_slots")]
        hits = hits.unionByName(same.select("doc_id", "_row", "item_id", "n_windows", "_key", "_at", *none), allowMissingColumns=True)
    hits = checkpoint(hits)
    pair = ["doc_id", "_row", "item_id", "formed"]
    found = hits.groupBy(*pair, "n_windows", "_key").agg(F.count(F.lit(1)).alias("_n")).groupBy(*pair, "n_windows").agg(F.count(F.lit(1)).alias("n_hits"))
    found = found.withColumn("containment", F.col("n_hits") / F.col("n_windows")).filter(F.col("containment") >= CONTAINMENT)
    cells = hits.filter("_slots > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1)))).filter(F.startswith(F.col("_kinds")[F.col("_k")], F.lit("#")))
    cells = cells.select(*pair, (F.col("_at") - F.col("_item_at")).alias("_shift"), (F.col("_item_at") + F.col("_k")).alias("_place"), F.col("_said")[F.col("_k")].alias("_said"), F.col("_says")[F.col("_k")].alias("_says"))
    # a place is in up to five windows and counts once
    cells = cells.groupBy(*pair, "_shift", "_place", "_said", "_says").agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.groupBy(*pair, "_shift", "_said", "_says").agg(F.count(F.lit(1)).alias("_n"))
    values = cells.groupBy(*pair, "_shift", "_said").agg(
        F.sum("_n").alias("_all"), F.max("_n").alias("_same"), F.max((F.col("_said") != F.col("_says")).cast("int")).alias("_other")
    )
    slots = values.groupBy(*pair).agg(F.sum("_all").alias("n_slots"), (F.sum("_same") / F.sum("_all")).alias("slot_agreement"), (F.max("_other") == 1).alias("reparameterised"))
    s = slots.select(*[F.col(c).alias(f"_s_{c}") for c in pair], "n_slots", "slot_agreement", "reparameterised")
    out = found.join(s, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in pair]), "left")
    out = out.fillna({"n_slots": 0, "slot_agreement": 1.0, "reparameterised": False}).filter(F.col("slot_agreement") >= AGREEMENT)
    told = ["n_windows", "n_hits", "containment", "n_slots", "slot_agreement", "reparameterised"]
    best = F.min_by(F.struct(*told), F.struct(-F.col("containment"), "formed"))
    return out.groupBy(*pair[:3]).agg(best.alias("_best")).select(*pair[:3], *[F.col(f"_best.{c}").alias(c) for c in told])


def _same_text(doc: str, row: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col("_row") == F.col(row))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all their columns, without those that leak an item.

    Null and empty texts stay; of repeated rows all stay or all go; an empty benchmark or table of documents changes nothing;
    columns may have any names. Texts move only if the rows that go are too many to broadcast.
    """
    a, b = fresh(docs.columns, "_lost_id", "_lost_row")
    lost = checkpoint(find_leaks(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias(a), F.col("_row").alias(b)).distinct())
    same = F.col(id_col).eqNullSafe(F.col(a)) & (F.xxhash64(F.col(text_col)) == F.col(b))
    return docs.join(broadcast_if_small(lost, lost.count()), same, "left_anti")
