"""URL filter by the ratio of two character language models, by DataFrame operations alone.

Two variable-order Markov models (contexts of up to ORDER characters, Witten-Bell smoothed down to shorter ones) are
learned from accepted and from rejected URLs. A URL is judged by the difference of its two log-likelihoods over its
length, against a calibrated threshold. Lists of rules come first.

Seed words in hosts are noisy labels, used once: URLs whose host has one are rejected, others that no block rule fits are
accepted, and sites are dealt into FOLDS folds. Every URL is scored by models that saw no URL of its fold, so by how it
reads and not by whether its site is known. The threshold is the smallest one, 0 at least, at which the share of rejected
URLs below it and that of accepted ones above it are about least together. Accepted URLs above it change sides, and the
final models are learned from the labels so mended: an unwanted site that no seed lists is learned as a rejected one.

Runs of digits count as one, so equal shapes are one string, learned with a weight that grows as the logarithm of its rows.
Weights are whole numbers, so that sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpoint, counted

ORDER = 4
ALPHABET = 64
FOLDS = 5
#: Weight of a shape: so many times the logarithm of one more than its rows.
SCALE = 1000
#: Thresholds that are tried.
GRID = tuple(round(0.02 * k, 2) for k in range(101))
#: Share of accepted URLs that are taken to be unwanted ones that no seed lists.
NOISE = 0.02
#: First labels of hosts that do not tell sites apart. Fixed values.
FRONTS = ("www", "m", "mobile", "amp", "blog", "news", "shop", "old", "new", "static", "cdn", "img")
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words of hosts that mark unwanted sites, as public block lists have them. Fixed values.
SEEDS = (
    "ads", "adult", "bets", "betting", "bonus", "casino", "cheap", "clickbait", "escort", "gambling", "jackpot", "loans",
    "lottery", "malware", "pharma", "phishing", "pills", "poker", "porn", "replica", "scam", "sex", "slots", "spam",
    "torrent", "track", "tracker", "viagra", "warez", "xxx",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without '://'."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; nulls if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule is asked before all shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def site_of(host: Column) -> Column:
    """The host without a first label that tells no site from another."""
    return F.regexp_replace(host, rf"^(?:{'|'.join(FRONTS)})\.", "")


def fold_of(site: Column) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(site), 1, 8), 16, 10).cast("long"), F.lit(FOLDS)).cast("int")


def _grams(strings: DataFrame) -> DataFrame:
    """A row for each character of shape: it and the up to ORDER characters before it; '^' stands before the first."""
    at = F.explode(F.sequence(F.lit(2), F.length("_padded")))
    rows = strings.withColumn("_padded", F.concat(F.lit("^"), F.col("shape"), F.lit("$"))).withColumn("_i", at)
    first = F.greatest(F.lit(1), F.col("_i") - ORDER)
    rows = rows.withColumn("context", F.substring(F.col("_padded"), first, F.col("_i") - first)).withColumn("char", F.substring(F.col("_padded"), F.col("_i"), F.lit(1)))
    return rows.drop("_padded", "_i")


def train(strings: DataFrame, folds: bool) -> DataFrame:
    """(context, char, ratios): ln of the rejected model's probability over the accepted one's, for every context of up to
    ORDER characters that occurs in strings (shape, accepted, rejected, weight, fold). ratios: with folds one for each fold,
    of models that did not see it; else one, of all."""
    models = range(FOLDS) if folds else [-1]
    grams = checkpoint(_grams(strings).groupBy("context", "char", "fold").agg(*[F.sum(F.when(F.col(c), F.col("weight")).otherwise(0)).alias(n) for c, n in (("accepted", "a"), ("rejected", "r"))]))
    orders = F.explode(F.sequence(F.lit(0), F.length("context")))
    parts = grams.withColumn("_k", orders).withColumn("key", F.expr("right(context, _k)"))
    seen = [F.sum(F.when(F.col("fold") != m, F.col(n)).otherwise(0)).alias(f"{n}{i}") for i, m in enumerate(models) for n in ("a", "r")]
    counts = parts.groupBy("key", "char").agg(*seen)
    sums = [x for i in range(len(models)) for n in ("a", "r") for x in (F.sum(f"{n}{i}").alias(f"{n}n{i}"), F.sum((F.col(f"{n}{i}") > 0).cast("long")).alias(f"{n}t{i}"))]
    totals = counts.groupBy("key").agg(*sums)
    wanted = grams.select("context", "char").distinct().withColumn("_k", orders).withColumn("key", F.expr("right(context, _k)"))
    steps = wanted.join(totals, "key").join(counts, ["key", "char"], "left").fillna(0)
    names = [f"{n}{t}{i}" for i in range(len(models)) for n in ("a", "r") for t in ("", "n", "t")]
    path = steps.groupBy("context", "char").agg(F.sort_array(F.collect_list(F.struct("_k", *names))).alias("_steps"))  # ORDER + 1 rows at most

    def log_p(n: str, i: int) -> Column:
        mix = f"(s.{n}{i} + {SCALE} * s.{n}t{i} * p) / (s.{n}n{i} + {SCALE} * s.{n}t{i})"
        return F.expr(f"ln(aggregate(_steps, {1 / ALPHABET}D, (p, s) -> case when s.{n}n{i} > 0 then {mix} else p end))")

    return path.select("context", "char", F.array(*[log_p("r", i) - log_p("a", i) for i in range(len(models))]).alias("ratios"))


def score_shapes(strings: DataFrame, folds: bool = False) -> DataFrame:
    """strings with score: the difference of log-likelihoods over the number of characters, rounded to nine places."""
    model = checkpoint(train(strings, folds))
    grams = _grams(strings).select("shape", "fold", "context", "char")
    own = F.element_at("ratios", F.col("fold") + 1 if folds else F.lit(1))
    scored = grams.join(broadcast_if_small(model, model.count()), ["context", "char"]).groupBy("shape").agg(F.round(F.avg(own), 9).alias("score"))
    return strings.join(scored, "shape")


def calibrate(scored: DataFrame) -> float:
    """The smallest threshold of GRID at which the shares of rejected URLs below it and of accepted ones above it come, together,
    within NOISE of the least that any threshold gives."""
    count = lambda c, rows: F.count(F.when(rows, True)).alias(c)
    accepted, score = F.col("accepted") & ~F.col("rejected"), F.col("score")
    both = [x for i, t in enumerate(GRID) for x in (count(f"a{i}", accepted & (score > t)), count(f"r{i}", F.col("rejected") & (score <= t)))]
    row = scored.agg(count("a", accepted), count("r", F.col("rejected")), *both).first()
    loss = [row[f"a{i}"] / row["a"] + row[f"r{i}"] / row["r"] for i in range(len(GRID))]
    return next(t for t, x in zip(GRID, loss, strict=True) if x <= min(loss) + NOISE)


def judge_urls(pages: DataFrame, rules=RULES, seeds=SEEDS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (higher: likelier rejected).

    The models read whole URLs of any length: scheme, host, path, query and fragment, or all of a string without '://'.
    Null urls and such without '://' have an empty host and path; null is judged as the empty string. If there are no
    accepted or no rejected URLs to learn from, the method allows, and an empty table stays empty. Repeated rows are judged
    alike; ids may be null; other columns are not read.
    """
    host, path = split_url(F.col(url_col))
    shape = F.regexp_replace(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"\d+", "0")
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), shape.alias("_shape"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_verdict", verdict)
    marked = F.arrays_overlap(F.split("host", r"[.\-_\d]+"), F.array(*[F.lit(s) for s in seeds]))
    strings = rows.select("_shape", marked.alias("_marked"), "_verdict", site_of(F.col("host")).alias("_site")).groupBy(F.col("_shape").alias("shape")).agg(
        F.round(F.log1p(F.count(F.lit(1)).cast("double")) * SCALE).cast("long").alias("weight"),
        F.bool_or("_marked").alias("rejected"),
        F.bool_or(~F.col("_marked") & F.coalesce(F.col("_verdict") == "allow", F.lit(True))).alias("accepted"),
        fold_of(F.min("_site")).alias("fold"),
    )
    strings = checkpoint(strings)
    n, size = counted(strings, "shape")
    kinds = strings.agg(F.count(F.when(F.col("accepted") & ~F.col("rejected"), 1)), F.count(F.when(F.col("rejected"), 1))).first()
    if kinds[0] and kinds[1]:
        apart = checkpoint(score_shapes(strings, folds=True))
        threshold = calibrate(apart)
        unwanted = F.col("rejected") | (F.col("accepted") & (F.col("score") > threshold))
        mended = apart.withColumns({"rejected": unwanted, "accepted": F.col("accepted") & ~unwanted}).drop("score")
        scored = checkpoint(score_shapes(mended))
    else:
        scored, threshold = strings.withColumn("score", F.lit(0.0)), 0.0
    out = rows.join(broadcast_if_small(scored.select(F.col("shape").alias("_shape"), "score"), n, size), "_shape", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"))
