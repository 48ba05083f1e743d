"""Toxicity by weak supervision.

Sixteen voters (word lists, patterns, and lists of words mined from labelled rows) vote on every text. A generative label
model, a two-class latent model fitted by expectation maximisation to the counts of all vote patterns, estimates each
voter's hit rates; what pairs of voters agree on beyond that model is their correlation, and correlated voters share their
weight. Its posterior, of labelled and of other texts alike, is the label of a linear classifier over hashed words and
beginnings of words, which scores the texts; a logistic calibration on labelled rows sets its scale.

Labels, from the rows that the caller allows, are used for mining, the prior and the calibration alone: the classifier
learns posteriors only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces, slices, texts
from .common import checkpoint
from .quality import _BASE, _BASE_BACK, _K, _powers, bounded, labelled_sample

#: Word lists, one voter each. Fixed values.
LISTS = {
    "insults": "idiot idiots moron morons imbecile imbeciles cretin dumbass fool fools clown clowns loser losers dimwit halfwit blockhead jackass jerk",
    "contempt": "stupid pathetic worthless disgusting trash scum garbage filth filthy vermin useless ridiculous laughable repulsive vile parasite parasites subhuman",
    "profanity": "fuck fucking fucked fucker motherfucker shit shitty bullshit bitch bitches bastard bastards asshole assholes cunt dick prick slut whore wanker twat",
    "threats": "kill murder strangle stab shoot hang rape burn lynch exterminate behead",
    "german": "idioten vollidiot trottel depp dummkopf arschloch wichser schlampe hurensohn abschaum dreckig scheiße scheisse missgeburt versager",
    "french": "connard connards connasse salope putain merde imbécile crétin abruti débile ordure enculé bâtard raté",
    "spanish": "idiota idiotas imbécil estúpido estúpida puta puto mierda cabrón gilipollas pendejo basura asqueroso escoria inútil",
    "slights": "ugly hate hates hated shut moronic idiotic brainless spineless coward cowards liar liars ignorant lazy crap damn sucks",
}
MINED = 4
#: Words of each mined voter, at most, and how many times likelier such a word is in texts of label 1.
MINED_WORDS = 48
MINED_ODDS = 40
#: Bytes of the beginnings of longer words that are features too.
PREFIXES = (5, 6, 7, 8, 9)
PATTERNS = ("shout", "bangs", "you_are", "stacked")
VOTERS = (*LISTS, *PATTERNS, *(f"mined_{i}" for i in range(MINED)))
BITS = 20
#: Words of the classifier, at most.
VOCABULARY = 2048
#: Texts of the sample that a word must be in to be learned.
MIN_TEXTS = 4
#: Most labelled rows of each class for mining and calibration (the documented bound), chosen by a hash of their ids.
SAMPLE = 2500
#: Most texts whose posterior is over a half, and most others, that join them for the classifier (documented bounds).
UNLABELLED = 2500
#: Most bytes of words of either sample that the driver holds.
SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.3
#: Bytes of one text whose words are hashed at once.
SPAN = 1 << 18

_INK = re.compile(rb"[^ ]")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BANGS = re.compile(rb"[!?]{3,}")
_YOU_ARE = re.compile(rb"\b(?:you|u|he|she|they) (?:are|re|r|is) (?:a |an |all |such |so |just |nothing but )*(\w+)")


def feature_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of folded data, which begins and ends with a space, and then of the
    beginnings (of PREFIXES bytes) of its longer words."""
    starts, h, prefix, back, ends = _hashes(data)
    at, found = [starts], [_mix(h)]
    for n in PREFIXES:
        longer = starts[ends - starts > n]
        at.append(longer)
        found.append(_mix((prefix[longer + n] - prefix[longer]) * back[longer] + np.uint64(n << 8)))
    return np.concatenate(at), np.concatenate(found)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words alone."""
    starts, h, _, _, _ = _hashes(data)
    return starts, _mix(h)


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * _K


def _hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = np.frombuffer(data, np.uint8)
    space = c == 32
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    prefix = np.r_[np.uint64(0), np.cumsum((c.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(c)), dtype=np.uint64)]
    back = _powers(_BASE_BACK, len(c))
    return starts, (prefix[ends] - prefix[starts]) * back[starts], prefix, back, ends


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_of(word: str) -> int:
    return int(buckets(word_hashes(b" " + word.encode() + b" ")[1])[0])


def text_features(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of all words and beginnings of a whole text, about SPAN bytes at a time. It is parted between words; a word
    longer than that is hashed in parts."""
    data, at = text.translate(_FOLD), 0
    while (first := _INK.search(data, at)) is not None:
        at, end = first.start(), len(data)
        if end - at > SPAN:
            end = data.rfind(b" ", at, at + SPAN)
            if end < 0:
                end = data.find(b" ", at)
                end = len(data) if end < 0 else end
                yield _long_word(data, at, end)
                at = end
                continue
        yield buckets(feature_hashes(b" " + data[at:end] + b" ")[1])
        at = end


def _long_word(data: bytes, start: int, end: int) -> np.ndarray:
    h = 0
    for at in range(start, end, SPAN):
        c = np.frombuffer(data, np.uint8, min(SPAN, end - at), at).astype(np.uint64) + np.uint64(1)
        h += int((c * _powers(_BASE, len(c))).sum(dtype=np.uint64)) * pow(_BASE, at - start, 1 << 64)
    begin = feature_hashes(b" " + data[start : start + max(PREFIXES) + 1] + b" ")[1][1:]
    return buckets(np.r_[_mix(np.array([h % (1 << 64)], np.uint64)), begin])


def presence(text: bytes) -> np.ndarray:
    """Buckets of the distinct words and beginnings of a whole text, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(np.unique(b) for b in text_features(text))]))


@dataclass(frozen=True)
class Voters:
    """lists[b]: bits of the word-list voters that bucket b belongs to."""

    lists: np.ndarray

    @staticmethod
    def build(mined: list[list[int]]) -> Voters:
        lists = np.zeros(1 << BITS, np.uint32)
        for k, words in enumerate(LISTS.values()):
            for w in words.split():
                lists[bucket_of(w)] |= np.uint32(1 << k)
        for k, found in enumerate(mined):
            lists[found] |= np.uint32(1 << (len(LISTS) + len(PATTERNS) + k))
        return Voters(lists)

    def votes(self, batch: list[bytes]) -> np.ndarray:
        """A bit for each voter that fires, for every text, taken over the whole text."""
        out = np.zeros(len(batch), np.int64)
        for a, b in pieces(batch):
            if len(batch[a]) > SPAN:  # a piece of its own
                listed = presence(batch[a])
                listed = listed[self.lists[listed] != 0]
                hits = np.stack([np.zeros(len(listed), np.int64), listed])
            else:
                hits = np.unique(self._hits(batch[a:b]), axis=1)
            out[a:b] = self._votes(batch[a:b], hits)
        return out

    def _hits(self, batch: list[bytes]) -> np.ndarray:
        """The listed buckets that texts have: place of the text in the batch, and bucket."""
        data = b"".join(b" " + t + b" " for t in batch).translate(_FOLD)
        heads = np.cumsum([0, *(len(t) + 2 for t in batch)])[:-1]
        starts, h = feature_hashes(data)
        found = buckets(h)
        hits = np.flatnonzero(self.lists[found])
        return np.stack([np.searchsorted(heads, starts[hits], "right") - 1, found[hits]])

    def _votes(self, batch: list[bytes], hits: np.ndarray) -> np.ndarray:
        """hits: distinct columns of what _hits gives."""
        owner, found = hits
        out = np.zeros(len(batch), np.uint32)
        np.bitwise_or.at(out, owner, self.lists[found])
        first = len(LISTS)
        for i, t in enumerate(batch):
            if len(t) >= 20 and (len(t) - len(t.translate(None, _UPPER))) * 2 > len(t):
                out[i] |= np.uint32(1 << first)
            if _BANGS.search(t):
                out[i] |= np.uint32(1 << (first + 1))
        for i in np.unique(owner):
            if any(self.lists[buckets(word_hashes(b" " + m[1] + b" ")[1])].any() for m in _YOU_ARE.finditer(batch[i].translate(_FOLD))):
                out[i] |= np.uint32(1 << (first + 2))
        out[np.bincount(owner, minlength=len(batch)) >= 2] |= np.uint32(1 << (first + 3))
        return out.astype(np.int64)


_UPPER = bytes(range(65, 91))


@dataclass(frozen=True)
class LabelModel:
    """Hit rates of each voter on clean and toxic texts, the prior, and each voter's share after correlations."""

    rates: np.ndarray
    prior: float
    share: np.ndarray
    correlation: np.ndarray

    @staticmethod
    def fit(patterns: np.ndarray, counts: np.ndarray, prior: float, rounds: int = 60) -> LabelModel:
        """Expectation maximisation over vote patterns (bit sets) with their counts. The prior stays as given."""
        m = len(VOTERS)
        votes = ((patterns[:, None] >> np.arange(m)) & 1).astype(float)
        n = counts.astype(float)
        prior = float(np.clip(prior, 1e-4, 0.5))
        rates = np.stack([np.full(m, 0.01), np.full(m, 0.3)])
        # patterns (shouting and the like) are weak at first; lists are taken at their word
        rates[1, len(LISTS) : len(LISTS) + len(PATTERNS) - 1] = 0.05
        p = np.zeros(len(n))
        for _ in range(rounds):
            z = np.log(prior / (1 - prior)) + votes @ np.log(rates[1] / rates[0]) + (1 - votes) @ np.log((1 - rates[1]) / (1 - rates[0]))
            p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            for k, w in enumerate((n * (1 - p), n * p)):
                rates[k] = np.clip((w @ votes + (0.01, 0.3)[k] * 2) / (w.sum() + 2), 1e-4, 0.999)
        # agreement beyond the model, as a correlation of the residuals
        expected = p[:, None] * rates[1] + (1 - p[:, None]) * rates[0]
        rest = votes - expected
        cov = (rest * n[:, None]).T @ rest / max(n.sum(), 1)
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        corr = cov / scale[:, None] / scale
        share = 1 / (1 + np.maximum(corr - np.eye(m), 0).sum(axis=1))
        return LabelModel(rates, prior, share, corr)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = ((patterns[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)
        gain = votes * np.log(self.rates[1] / self.rates[0]) + (1 - votes) * np.log((1 - self.rates[1]) / (1 - self.rates[0]))
        z = np.log(self.prior / (1 - self.prior)) + gain @ self.share
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class Classifier:
    """Weights of words by bucket; the score of a text is the calibrated sum over its distinct words."""

    weights: np.ndarray
    slope: float
    offset: float

    def scores(self, batch: list[bytes]) -> np.ndarray:
        z = np.zeros(len(batch))
        for a, b in pieces(batch):
            z[a:b] = self.weights[presence(batch[a])].sum() if len(batch[a]) > SPAN else self._sums(batch[a:b])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.offset, -50, 50)))

    def _sums(self, batch: list[bytes]) -> np.ndarray:
        data = b"".join(b" " + t + b" " for t in batch).translate(_FOLD)
        heads = np.cumsum([0, *(len(t) + 2 for t in batch)])[:-1]
        starts, h = feature_hashes(data)
        found = buckets(h)
        hits = np.flatnonzero(self.weights[found])
        if not len(hits):
            return np.zeros(len(batch))
        owner = np.searchsorted(heads, starts[hits], "right") - 1
        pairs = np.unique(np.stack([owner, found[hits]]), axis=1)
        return np.bincount(pairs[0], self.weights[pairs[1]], len(batch))


def _logistic(features: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 40, l2: float = 1e-4, rate: float = 0.2, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels over sets of column numbers, by AdaGrad."""
    rng = np.random.default_rng(seed)
    w, b, seen, seen_b = np.zeros(width), 0.0, np.full(width, 1e-8), 1e-8
    for _ in range(rounds):
        for k in rng.permutation(len(features)):
            f = features[k]
            g = weight[k] * (1 / (1 + np.exp(-np.clip(w[f].sum() + b, -30, 30))) - target[k])
            grad = g + l2 * w[f]
            seen[f] += grad**2
            w[f] -= rate * grad / np.sqrt(seen[f])
            seen_b += g * g
            b -= rate * g / np.sqrt(seen_b)
    return w, b


def _counts(sets: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << BITS)
    for s, w in zip(sets, weights, strict=True):
        out[s] += w
    return out


def mine(sets: list[np.ndarray], labels: np.ndarray) -> list[list[int]]:
    """Buckets of the words that mark label 1 best, dealt to the mined voters in turn: smoothed log odds, in texts."""
    pos, neg = float(labels.sum()), float((1 - labels).sum())
    if not pos or not neg:
        return [[] for _ in range(MINED)]
    a, b = _counts(sets, labels), _counts(sets, 1.0 - labels)
    odds = np.log((a + 0.1) / (pos + 0.2)) - np.log((b + 0.1) / (neg + 0.2))
    worth = np.where((a >= max(3, 0.004 * pos)) & (odds > np.log(MINED_ODDS)), (a / pos) * odds, 0)
    best = [int(x) for x in np.argsort(-worth)[: MINED * MINED_WORDS] if worth[x] > 0]
    return [best[i::MINED] for i in range(MINED)]


def _presence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        words = pa.array([presence(t).astype(np.uint32).tobytes() for t in texts(batch.column("_text"))], pa.binary())
        rest = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), words], [*rest, "words"])


def _sets(rows: list) -> list[np.ndarray]:
    return [np.frombuffer(r["words"], np.uint32).astype(np.int64) for r in rows]


@dataclass(frozen=True)
class Model:
    voters: Voters
    labels: LabelModel
    classifier: Classifier


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", per_class: int = SAMPLE) -> Model:
    """The model, from a bounded sample of labelled documents where learn holds, a bounded sample of other documents where it
    holds, and the vote patterns of all documents.

    Without labels of both classes nothing is mined or calibrated and the word lists alone decide. A repeated id counts once,
    with the text that sorts first; null ids and labels teach nothing, null texts are empty ones; very long texts are read whole.
    """
    spark = docs.sparkSession
    sample, totals = labelled_sample(labels, label_col, learn, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    picked = rows.join(F.broadcast(sample), "doc_id")
    # 2 * per_class rows at most, as a repeated id gives one; written once, so that words and votes are of the same text
    picked = checkpoint(picked.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("_text").alias("_text")))
    held = bounded(picked.mapInArrow(_presence_rows, "doc_id long, label int, words binary"), SAMPLE_BYTES, "words").orderBy("doc_id").collect()
    sets = _sets(held)
    y = np.array([r["label"] for r in held], float)
    both = len(set(y.tolist())) == 2
    share = totals[1] / max(1, sum(totals)) if both else 0.05
    voters = Voters.build(mine(sets, y) if both else [[] for _ in range(MINED)])

    shared = spark.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes = pa.array(shared.value.votes(texts(batch.column("_text"))))
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), votes], [*rest, "votes"])

    own = {r["doc_id"]: r["votes"] for r in picked.select("doc_id", "_text").mapInArrow(vote, "doc_id long, votes long").collect()}
    voted = checkpoint(rows.withColumn("_row", F.xxhash64("_text")).mapInArrow(vote, "doc_id long, _row long, votes long"))
    # at most 2 ** 16 patterns: a proven bound
    patterns = voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    found, counts = (np.array([r[c] for r in patterns], np.int64) for c in ("votes", "n"))
    model = LabelModel.fit(found, counts, share)
    if not both:
        return Model(voters, model, list_classifier(voters, model))
    votes = [np.array([own[r["doc_id"]] for r in held], np.int64)]
    weight = [np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())]
    for over in (True, False):
        side = (model.posterior(found) >= 0.5) == over
        # 2 ** 16 rows at most
        of_side = F.broadcast(spark.createDataFrame([(int(v),) for v in found[side]], "votes long"))
        others = voted.filter(F.col("doc_id").isNotNull() & learn).join(of_side, "votes").join(F.broadcast(sample), "doc_id", "left_anti").distinct()
        others = checkpoint(others.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id", "_row").limit(UNLABELLED))
        texts_of = rows.withColumn("_row", F.xxhash64("_text")).join(F.broadcast(others), ["doc_id", "_row"]).dropDuplicates(["doc_id", "_row"])  # UNLABELLED rows
        words = texts_of.select("doc_id", "_row", "votes", F.lit(int(over)).alias("label"), "_text").mapInArrow(_presence_rows, "doc_id long, _row long, votes long, label int, words binary")
        more = bounded(words, SAMPLE_BYTES, "words").orderBy("doc_id", "_row").collect()
        sets += _sets(more)
        votes.append(np.array([r["votes"] for r in more], np.int64))
        weight.append(np.full(len(more), counts[side].sum() / max(1, len(more))))
    rest = np.concatenate(weight[1:])
    weights = np.r_[weight[0], rest / rest.mean() if len(rest) else rest]
    return Model(voters, model, fit_classifier(sets, model.posterior(np.concatenate(votes)), weights, y, voters, model))


def _listed(voters: Voters, model: LabelModel, columns: np.ndarray) -> np.ndarray:
    """The label model's gain of the lists that buckets are in."""
    gain = np.log(model.rates[1] / model.rates[0]) * model.share
    return np.maximum((((voters.lists[columns][:, None] >> np.arange(len(VOTERS))) & 1) * gain).max(axis=1, initial=0), 0)


def list_classifier(voters: Voters, model: LabelModel) -> Classifier:
    """What the lists alone say, for want of labels."""
    weights = np.zeros(1 << BITS)
    columns = np.flatnonzero(voters.lists)
    weights[columns] = _listed(voters, model, columns)
    return Classifier(weights.astype(np.float32), 1.0, float(np.log(model.prior / (1 - model.prior))))


def fit_classifier(sets: list[np.ndarray], post: np.ndarray, weight: np.ndarray, y: np.ndarray, voters: Voters, model: LabelModel) -> Classifier:
    """The linear classifier from posteriors, post. sets: the words of its texts, of which the first have the labels y, by
    which it is calibrated."""
    worth = _information(_counts(sets, post), _counts(sets, 1 - post), post.sum(), (1 - post).sum())
    columns = np.flatnonzero(voters.lists)
    columns = np.union1d(columns, np.argsort(-worth)[: min(max(0, VOCABULARY - len(columns)), np.count_nonzero(worth))])
    place = np.full(1 << BITS, -1)
    place[columns] = np.arange(len(columns))
    features = [place[s][place[s] >= 0] for s in sets]
    # out of fold sums, so that the calibration sees what new texts get
    z, fold = np.zeros(len(sets)), np.arange(len(sets)) % 5
    for k in range(5):
        use = np.flatnonzero(fold != k)
        wk, bk = _logistic([features[i] for i in use], post[use], weight[use], len(columns))
        z[fold == k] = [wk[features[i]].sum() + bk for i in np.flatnonzero(fold == k)]
    slope, offset = _calibrate(z[: len(y)], y, weight[: len(y)])
    learned, b = _logistic(features, post, weight, len(columns))
    seen = np.zeros(len(columns), bool)
    for f in features:
        seen[f] = True
    # words of the lists that the samples lack keep the label model's gain as their weight
    weights = np.zeros(1 << BITS)
    weights[columns] = np.where(seen, learned, _listed(voters, model, columns))
    return Classifier(weights.astype(np.float32), slope, offset + slope * b)


def _information(a: np.ndarray, b: np.ndarray, pos: float, neg: float) -> np.ndarray:
    """Mutual information of a feature's presence (in a of pos and b of neg texts) and the class; 0 for rare features."""
    n = pos + neg

    def part(joint: np.ndarray, row: np.ndarray, column: float) -> np.ndarray:
        return np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-12) * n / np.maximum(row * column, 1e-12)), 0)

    has, lacks = a + b, n - a - b
    info = part(a, has, pos) + part(b, has, neg) + part(pos - a, lacks, pos) + part(neg - b, lacks, neg)
    return np.where(has >= MIN_TEXTS, info, 0)


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic calibration, by Newton steps with a weak pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p) + 1e-6
        grad = np.array([(g * z).sum() + 1e-2 * (a - 1), g.sum() + 1e-2 * b])
        hess = np.array([[(h * z * z).sum() + 1e-2, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        step = np.clip(step, -1, 1)
        a, b = a - step[0], b - step[1]
    return float(max(a, 0.05)), float(b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and score. Null texts count as empty; repeated rows get equal scores; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model.classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(texts(batch.column("_text"))))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "doc_id long, score double")
