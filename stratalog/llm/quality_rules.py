"""Quality rules with risk-controlled cutoffs, by DataFrame operations alone.

Each statistic (higher is worse) has a fixed ladder of candidate cutoffs. For each stratum (language) labelled good
documents are counted above every cutoff, and the exact binomial tail P(Bin(n, alpha / statistics) <= k) tests whether
the cutoff rejects more good documents than its share of alpha. Ladders are walked from the loosest cutoff on and end at
the first failure (fixed-sequence testing), and delta is divided by strata times statistics (Bonferroni): with
probability 1 - delta no stratum loses more than alpha of its good documents to the method. Among the certified cutoffs
the one with the best balance of rejected bad and good labelled documents is used, or none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, broadcast_if_small, checkpoint, counted, let, text_or_empty, word_array

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Statistics, each a share from 0 to 1 of the words' characters, lines or words.
STATISTICS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bang_share": "n_bang / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
}
#: Candidate cutoffs of every statistic, from the loosest to the strictest.
LADDER = tuple(round(0.9 * 0.85**i, 4) for i in range(32))


@dataclass(frozen=True)
class Risk:
    """alpha: most good documents lost per stratum; delta: chance that this fails; cost: bad documents a good one is worth."""

    alpha: float = 0.05
    delta: float = 0.05
    cost: float = 5.0


def window_hashes(words: Column, n: int = 5) -> Column:
    """The 64-bit hashes of all n-word windows, in order."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[h[i + k] for k in range(n)]))
        ),
    )


def repeated_words(hashes: str, n: int = 5) -> Column:
    """Words inside windows whose hash occurs twice or more. hashes: the column's name.

    Most texts repeat no window and end after one hash set; the rest sort (hash, position) pairs, so a long text costs
    n log n.
    """
    return F.expr(f"""
        case when size(array_distinct({hashes})) = size({hashes}) then 0L else
          element_at(transform(array(sort_array(transform({hashes}, (x, i) -> named_struct('x', x, 'i', i)))), s ->
            aggregate(
              sort_array(filter(transform(sequence(0, size(s) - 1), k ->
                case when k > 0 and s[greatest(k - 1, 0)].x = s[k].x then s[k].i
                     when k < size(s) - 1 and s[least(k + 1, size(s) - 1)].x = s[k].x then s[k].i end), p -> p is not null)),
              named_struct('t', 0L, 'at', {-n}),
              (a, p) -> named_struct('t', a.t + cast(least({n}, p - a.at) as bigint), 'at', p),
              a -> a.t)), 1) end""")


def removed(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: doc_id, _stratum and its counts. Null texts are empty; a null stratum is the stratum ''."""
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("_stratum"), text.alias("_text"))
    rows = rows.withColumn("_words", word_array(F.col("_text"))).withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD)))
    rows = rows.withColumn("_hashes", window_hashes(F.col("_words")))
    return rows.select(
        "doc_id",
        "_stratum",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        removed(F.col("_text"), SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_hashes").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        removed(F.col("_text"), UPPER).alias("n_upper"),
        removed(F.col("_text"), "!").alias("n_bang"),
    )


def _log_gamma(z: str) -> str:
    """SQL for ln Gamma(z), z >= 1: Stirling's series eight steps up."""
    up = f"(({z}) + 8)"
    steps = " * ".join(f"(({z}) + {i})" for i in range(8))
    return f"(({up} - 0.5D) * ln({up}) - {up} + {0.9189385332046727}D + 1D / (12 * {up}) - 1D / (360 * pow({up}, 3)) + 1D / (1260 * pow({up}, 5)) - ln({steps}))"


def binomial_tail(k: str, n: str, p: str) -> Column:
    """P(Bin(n, p) <= k), exact to double precision for k below n * p; 1 from there on (no such cutoff is certified).

    The terms shrink from k downwards: the i-th is at most exp(-i * i / (2 * n * p)) of the first, so that after 40
    square roots of n * p nothing is left of them, and all before are summed, whatever n is.
    """
    n_, k_, p_ = f"cast({n} as double)", f"cast({k} as double)", f"cast({p} as double)"
    log_top = f"{_log_gamma(f'{n_} + 1')} - {_log_gamma(f'{k_} + 1')} - {_log_gamma(f'{n_} - {k_} + 1')} + {k_} * ln({p_}) + ({n_} - {k_}) * ln(1 - {p_})"
    series = f"""aggregate(sequence(0L, least(greatest({k}, 1L), cast(40 * sqrt({n_} * {p_}) + 40 as bigint)) - 1), named_struct('t', 1D, 's', 1D),
        (a, i) -> named_struct('t', a.t * ({k_} - i) / ({n_} - {k_} + i + 1) * (1 - {p_}) / {p_},
                               's', a.s + a.t * ({k_} - i) / ({n_} - {k_} + i + 1) * (1 - {p_}) / {p_}), a -> a.s)"""
    return F.expr(f"case when {k} >= {n} * {p_} then 1D else least(1D, exp({log_top}) * {series}) end")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def select_cutoffs(features: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """_stratum and a cutoff for each statistic (null: none certified), from all labelled rows that the base rules keep.

    labels: doc_id and quality (1 good, 0 bad); repeated labels of an id count once, conflicting ones as good.
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    names = list(STATISTICS)
    ladder = F.array(*[F.lit(c) for c in LADDER])
    held = features.filter(~base_failed()).join(marks, "doc_id")
    # how many cutoffs of the ladder reject the document, counted from the strictest
    steps = [F.size(F.filter(ladder, lambda c: F.col(f"_value_{n}") > c)) for n in names]  # noqa: B023  read at once
    held = held.withColumns({f"_value_{n}": F.expr(e) for n, e in STATISTICS.items()})
    counts = held.select("_stratum", "_good", F.explode(F.array(*[F.struct(F.lit(n).alias("statistic"), s.alias("step")) for n, s in zip(names, steps, strict=True)])).alias("_s"))
    counts = checkpoint(
        counts.groupBy("_stratum", "_s.statistic", "_s.step").agg(F.sum(F.when(F.col("_good") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_good") == 1, 0).otherwise(1)).alias("bad"))
    )
    strata = counts.select("_stratum").distinct().count()
    share, least = risk.alpha / len(names), risk.delta / max(1, strata * len(names))
    # cutoff i of the ladder rejects the documents whose step is at least len(LADDER) - i
    rungs = F.explode(F.sequence(F.lit(0), F.lit(len(LADDER) - 1))).alias("rung")
    totals = counts.groupBy("_stratum", "statistic").agg(F.sum("good").cast("long").alias("n"))
    above = counts.select("*", rungs).filter(F.col("step") >= len(LADDER) - F.col("rung"))
    above = above.groupBy("_stratum", "statistic", "rung").agg(F.sum("good").cast("long").alias("k"), F.sum("bad").cast("long").alias("caught"))
    tested = totals.select("*", rungs).join(above, ["_stratum", "statistic", "rung"], "left").fillna(0, ["k", "caught"])
    tested = tested.withColumn("fails", (binomial_tail("k", "n", str(share)) > least).cast("int"))
    walk = Window.partitionBy("_stratum", "statistic").orderBy("rung")
    certified = tested.withColumn("fails", F.max("fails").over(walk)).filter("fails = 0").withColumn("worth", F.col("caught") - risk.cost * F.col("k"))
    best = certified.filter("worth > 0").groupBy("_stratum", "statistic").agg(F.max_by("rung", F.struct("worth", -F.col("rung"))).alias("rung"))
    return best.groupBy("_stratum").pivot("statistic", names).agg(F.first(F.element_at(ladder, F.col("rung") + 1)))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: doc_id, its counts, base_failed, kept and broken (the statistics beyond their cutoffs).

    Null and empty texts fail the base rules. A stratum with too few labels to certify anything loses nothing to the method;
    a null stratum is one of its own. Repeated rows are judged alike and each counts where its id has a label; very long texts
    are read whole; an empty table stays empty, and without labels the base rules alone decide. Other columns are not read.
    """
    features = checkpoint(base_features(docs, id_col, text_col, stratum_col))
    cutoffs = checkpoint(select_cutoffs(features, labels, risk))
    rows = features.join(broadcast_if_small(cutoffs, *counted(cutoffs, "_stratum")), "_stratum", "left")
    broken = F.array_compact(F.array(*[F.when(F.expr(e) > F.col(n), F.lit(n)) for n, e in STATISTICS.items()]))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("broken", broken)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"), "broken"
    )
