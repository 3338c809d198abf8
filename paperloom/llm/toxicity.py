"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors.

1. One pass over all texts packs each row's distinct words; nothing after it reads a text.
2. Words and word beginnings that set toxic rows apart are counted over all labelled rows that may be learned from, by
   smoothed log odds. Every one that is ``STRONG`` votes, however many there are: they are dealt to lexicon voters by
   kind and hash. A filter of fixed size, sent with the tasks, picks out what may be strong; a join with the table of strong
   features settles it. Pattern voters look at shouting and at repeated hits.
3. The label model is fitted on the counts of vote patterns. A latent class explains the votes; EM estimates the class
   balance and each voter's rates under both classes, with the class of labelled rows that may be learned from held fixed. Voters that stay correlated given the class are joined to blocks with a rate for
   each of their joint votes, and EM runs again, so that voters which repeat one another do not count twice.
4. Strong features are weighed by the posteriors of all rows they occur in. A logistic regression on the ``FEATURES`` weightiest
   features learns the posteriors of a bounded sample of rows, starting from those weights; strong features beyond them keep theirs. The sum is the score.

Counts, votes, weights and scores cover every row. The filter, the list of fitted features, the 2^voters patterns and the
sample have fixed bounds; only they reach the driver or are sent with tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from paperloom.llm.store import forget, small, written

#: Rows that the classifier is fitted on (expected number).
FIT_ROWS = 20_000
#: Features that the classifier has a coefficient of its own for, and how many labelled rows a feature must occur in.
FEATURES = 2_000
LEAST_ROWS = 5
LEXICONS = {"w": 4, "5": 3, "4": 3}  # voters by kind: whole words, beginnings of five and four letters
VOTERS = sum(LEXICONS.values()) + 2
#: Log odds from which a feature's presence is a toxic vote.
STRONG = 3.0
#: Places of the filter for strong features.
MARKS = 1 << 22
#: Names counted in a task before they are passed on, and rows per batch.
NAMES = 200_000
SLICE = 512
_WORD = re.compile(r"[^\W\d_]+")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text is 0 modulo 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(words: list[str]) -> set[str]:
    """Distinct words and their beginnings, each with its kind."""
    found = {"w" + w for w in words}
    found |= {"5" + w[:5] for w in words if len(w) > 5}
    return found | {"4" + w[:4] for w in words if len(w) > 4}


def word_bags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, held_out, shout, words``: the distinct words of each whole text, packed; one row per input row."""
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                texts = [t or "" for t in part.column(2).to_pylist()]
                bags = [pack("\n".join(sorted(set(_WORD.findall(t.lower())))).encode()) for t in texts]
                shout = [t.count("!") * 20 > len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shout), pa.array(bags, pa.binary())], ["id", "held_out", "shout", "words"])

    bags = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, held_out boolean, shout boolean, words binary")
    return bags.withColumn("row", F.monotonically_increasing_id())


def _unpacked(column: pa.Array) -> Iterator[set[str]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for x in column:
        text = unpack(x.as_py()).decode()
        yield features_of(text.split("\n")) if text else set()


def feature_odds(labelled: DataFrame) -> DataFrame | None:
    """``feature, t, c, odds`` of the features in at least ``LEAST_ROWS`` rows of ``words, toxic``; None without both classes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def passed_on():
            names = list(toxic | clean)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([toxic[n] for n in names], pa.int64()), pa.array([clean[n] for n in names], pa.int64())],
                ["feature", "t", "c"])
            toxic.clear()
            clean.clear()
            return out

        for batch in batches:
            for found, y in zip(_unpacked(batch.column(0)), batch.column(1).to_pylist()):
                (toxic if y else clean).update(found)
                if len(toxic) + len(clean) > NAMES:
                    yield passed_on()
        yield passed_on()

    total = labelled.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    t, c = total["t"] or 0, total["n"] - (total["t"] or 0)
    if not t or not c:
        return None
    odds = F.log((F.col("t") + 0.5) / (t + 1.0)) - F.log((F.col("c") + 0.5) / (c + 1.0))
    counts = labelled.select("words", "toxic").mapInArrow(count, "feature string, t long, c long")
    return counts.groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= LEAST_ROWS).withColumn("odds", odds)


def _voter_bit() -> Column:
    """The bit of the lexicon voter that a feature is dealt to, by kind and hash."""
    first, place = 0, F.lit(0)
    for kind, n in LEXICONS.items():
        own = F.pmod(F.crc32(F.col("feature").cast("binary")), F.lit(n)).cast("int") + first
        place, first = F.when(F.startswith("feature", F.lit(kind)), own).otherwise(place), first + n
    return F.element_at(F.array(*[F.lit(1 << i).cast("long") for i in range(first)]), place + 1)


def _candidates(fitted: list[str], marks: np.ndarray):
    """Per row the fitted features as indexes, and the features whose place in the filter is marked."""
    index = {name: i for i, name in enumerate(fitted)}
    digest, low = xxhash.xxh64_intdigest, MARKS - 1  # Spark's xxhash64 of a text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, hits, maybe = batch.slice(at, SLICE), [], []
                for found in _unpacked(part.column("words")):
                    hits.append(sorted(index[f] for f in found & index.keys()))
                    names = list(found)
                    places = np.fromiter((digest(f, 42) & low for f in names), np.int64, len(names))
                    maybe.append([names[i] for i in np.flatnonzero(marks[places])])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(hits, pa.list_(pa.int32())), pa.array(maybe, pa.list_(pa.string()))], ["row", "hits", "maybe"])

    return run


def _correlation(votes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    n = max(weight.sum(), 1e-9)
    mean = votes @ weight / n
    cov = (votes * weight) @ votes.T / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
    return cov / np.outer(sd, sd)


class LabelModel:
    """Latent class over blocks of voters; ``fit`` on vote patterns with counts, ``posterior`` per pattern."""

    def __init__(self, voters: int = VOTERS, rounds: int = 60, joined: float = 0.3, widest: int = 6):
        self.voters, self.rounds, self.joined, self.widest = voters, rounds, joined, widest
        self.blocks = [[v] for v in range(voters)]
        self.prior, self.rates = 0.1, []
        self.accuracy: list[tuple[float, float]] = []
        self.correlation = np.zeros((voters, voters))

    def _codes(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [sum(((patterns >> v) & 1) << k for k, v in enumerate(block)) for block in self.blocks]

    def _em(self, codes: list[np.ndarray], counts: np.ndarray, known: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            soft = np.stack([counts * (1 - posterior), counts * posterior]) + known
            self.prior = float((soft[1].sum() + 1) / (soft.sum() + 2))
            self.rates = []
            for code, block in zip(codes, self.blocks):
                got = np.stack([np.bincount(code, s, 1 << len(block)) for s in soft]) + 0.05
                self.rates.append(got / got.sum(1, keepdims=True))
            posterior = self._posterior(codes)
        return posterior

    def _posterior(self, codes: list[np.ndarray]) -> np.ndarray:
        log = np.log(self.prior) - np.log1p(-self.prior) + sum(
            np.log(rate[1][code]) - np.log(rate[0][code]) for rate, code in zip(self.rates, codes))
        return 1 / (1 + np.exp(-np.clip(log, -50, 50)))

    def fit(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray) -> "LabelModel":
        """``counts`` of rows without a class and ``known[class]`` counts of rows with one, per pattern of votes."""
        votes = np.stack([(patterns >> v) & 1 for v in range(self.voters)]).astype(float)
        # voters that all but copy each other would be taken for the class itself: one block from the start
        self.correlation = np.where(np.abs(raw := _correlation(votes, counts + known.sum(0))) > 0.9, raw, 0.0)
        self._join()
        start = np.clip(votes.mean(0) * 4, 0.02, 0.98)  # votes are toxic or absent: more of them, likelier
        posterior = self._em(self._codes(patterns), counts, known, start)
        for soft in (counts * posterior + known[1], counts * (1 - posterior) + known[0]):
            corr = _correlation(votes, soft)
            self.correlation = np.where(np.abs(corr) > np.abs(self.correlation), corr, self.correlation)
        self.accuracy = [(float(votes[v] @ (counts * posterior + known[1]) / max((counts * posterior + known[1]).sum(), 1e-9)),
                          float(votes[v] @ (counts * (1 - posterior) + known[0]) / max((counts * (1 - posterior) + known[0]).sum(), 1e-9)))
                         for v in range(self.voters)]  # vote rates under toxic and under clean
        self._join()
        self._em(self._codes(patterns), counts, known, posterior)
        return self

    def _join(self) -> None:
        """Blocks of voters by decreasing correlation, up to a width."""
        block = {v: [v] for v in range(self.voters)}
        pairs = [(abs(self.correlation[a, b]), a, b) for a in range(self.voters) for b in range(a)]
        for strength, a, b in sorted(pairs, reverse=True):
            if strength > self.joined and block[a] is not block[b] and len(block[a]) + len(block[b]) <= self.widest:
                both = block[a] + block[b]
                for v in both:
                    block[v] = both
        self.blocks = [list(x) for x in dict.fromkeys(tuple(b) for b in block.values())]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(self._codes(patterns))


def fit_linear(hits: list[list[int]], target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 400, ridge: float = 1e-4,
               prior: np.ndarray | None = None, offset: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression on indicator features by accelerated gradient steps; the last coefficient is the intercept.

    Coefficients are drawn to ``prior``, zero by default, and start there; ``offset`` is added to each row's sum.
    """
    at = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    column = np.concatenate([np.asarray(h, np.int64) for h in hits]) if len(at) else np.zeros(0, np.int64)
    weight = weight / weight.sum()
    prior = np.zeros(width + 1) if prior is None else prior
    offset = np.zeros(len(hits)) if offset is None else offset
    w, ahead, old = prior.copy(), prior.copy(), 1.0
    widest = max(1.0, float(np.mean([len(h) for h in hits])) + 1 if hits else 1.0)
    for _ in range(rounds):
        z = offset + ahead[-1] + np.bincount(at, ahead[column], len(hits))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)
        slope = np.append(np.bincount(column, error[at], width), error.sum()) + ridge * (ahead - prior)
        new, t = ahead - 4.0 / widest * slope, (1 + np.sqrt(1 + 4 * old * old)) / 2
        ahead, w, old = new + (old - 1) / t * (new - w), new, t
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted``: one row per row of ``docs``.

    ``labels`` has ``id_col, toxic``; null labels teach nothing. Null and empty texts have no votes or features and get the
    intercept's score. Rows with equal texts score alike. Without labels of both classes every score is the share of toxic
    labels, 0 if there are none. Only the text makes a score.
    """
    taught = labels.where(F.col("toxic").isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    once = taught.groupBy("id").agg(F.max("toxic").alias("toxic"))
    bags = written(word_bags(docs, id_col, text_col), "toxic-bags")
    # the same join at every size: packed words meet labels, and texts stay where they are
    labelled = written(bags.where("NOT held_out").select("id", "words").join(once.hint("merge"), "id").select("words", "toxic"), "toxic-labelled")
    odds = feature_odds(labelled)
    if odds is None or (known := written(odds, "toxic-features")).isEmpty():
        share = float(taught.agg(F.avg("toxic")).first()[0] or 0.0)
        return bags.select(F.col("id").alias(id_col), "held_out", F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    weight = F.abs(F.col("odds")) * F.sqrt(F.col("t") + F.col("c"))
    fitted = [r[0] for r in known.orderBy(weight.desc(), "feature").limit(FEATURES).select("feature").collect()]
    strong = written(known.where(F.col("odds") >= STRONG).select("feature", _voter_bit().alias("bit")), "toxic-strong")
    marks = np.zeros(MARKS, bool)
    marks[[r[0] for r in strong.select(F.pmod(F.xxhash64("feature"), F.lit(MARKS))).distinct().collect()]] = True  # MARKS at most
    found = written(bags.select("row", "words").mapInArrow(_candidates(fitted, marks), "row long, hits array<int>, maybe array<string>"), "toxic-found")
    hits = written(found.select("row", F.explode("maybe").alias("feature")).join(small(strong), "feature"), "toxic-hits")
    lexicon = hits.groupBy("row").agg(F.bit_or("bit").alias("bits"), F.count(F.lit(1)).alias("n"))
    shout, often = (F.lit(1 << (VOTERS - k)).cast("long") for k in (2, 1))
    pattern = F.coalesce("bits", F.lit(0).cast("long")) + F.when(F.col("n") >= 3, often).otherwise(0) + F.when(F.col("shout"), shout).otherwise(0)
    votes = written(bags.drop("words").join(lexicon, "row", "left").select("row", "id", "held_out", pattern.alias("votes")), "toxic-votes")
    learned = votes.where("NOT held_out")
    classes = (("free", F.col("toxic").isNull()), ("clean", F.col("toxic") == 0), ("bad", F.col("toxic") > 0))
    counted = learned.join(once, "id", "left").groupBy("votes").agg(*[F.count_if(c).alias(n) for n, c in classes]).collect()  # at most 2^VOTERS rows
    patterns = np.array([r["votes"] for r in counted], np.int64)
    free, fixed = np.array([r["free"] for r in counted], float), np.array([[r["clean"] for r in counted], [r["bad"] for r in counted]], float)
    counts = free + fixed.sum(0)
    model = LabelModel().fit(patterns, free, fixed)
    posterior = model.posterior(patterns)
    toxic = float(posterior @ counts)
    of_pattern = F.broadcast(docs.sparkSession.createDataFrame(list(zip(patterns.tolist(), posterior.tolist())), "votes long, p double"))
    weighed = hits.select("row", "feature").join(learned.select("row", "votes").join(of_pattern, "votes"), "row").groupBy("feature").agg(F.sum("p").alias("t"), F.count(F.lit(1)).alias("n"))
    own = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (float(counts.sum()) - toxic + 1.0))
    in_fit = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(fitted)], "feature string, place int")
    weights = written(strong.select("feature").join(weighed, "feature").join(F.broadcast(in_fit), "feature", "left").select("feature", "place", own.alias("odds")), "toxic-weights")
    prior = np.zeros(len(fitted) + 1)
    for r in weights.where("place IS NOT NULL").collect():  # FEATURES at most
        prior[r["place"]] = r["odds"]
    beyond = written(hits.select("row", "feature").join(small(weights.where("place IS NULL").select("feature", "odds")), "feature").groupBy("row").agg(F.sum("odds").alias("beyond")), "toxic-beyond")
    rows = _sample(learned, found, beyond, dict(zip(patterns.tolist(), counts.tolist())))
    seen, total = Counter(r["votes"] for r in rows), dict(zip(patterns.tolist(), counts.tolist()))
    linear = fit_linear(
        [r["hits"] for r in rows], model.posterior(np.array([r["votes"] for r in rows], np.int64)), np.array([total[r["votes"]] / seen[r["votes"]] for r in rows]),
        len(fitted), prior=prior, offset=np.array([r["beyond"] for r in rows], float)).tolist()
    table = F.array(*map(F.lit, linear[:-1]))
    z = F.aggregate("hits", F.lit(linear[-1]), lambda a, h: a + F.element_at(table, h + 1))
    sums = found.select("row", z.alias("z")).join(votes.select("row", "id", "held_out"), "row").join(beyond, "row", "left")
    score = 1 / (1 + F.exp(-(F.col("z") + F.coalesce("beyond", F.lit(0.0)))))
    forget(labelled, known)
    return sums.select(F.col("id").alias(id_col), "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _sample(learned: DataFrame, found: DataFrame, beyond: DataFrame, counts: dict[int, float]) -> list:
    """Rows to fit on, by a hash of the id: as many of each pattern, so that rare ones are in it; ``FIT_ROWS`` in expectation."""
    share = F.element_at(F.create_map(*[F.lit(x) for v, n in counts.items() for x in (v, FIT_ROWS / len(counts) / max(n, 1.0))]), F.col("votes"))
    key = F.concat(F.lit("fit"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.col("row").cast("string"))
    drawn = learned.where(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2.0**32 < share).select("row", "votes")
    sample = written(drawn, "toxic-sample")
    own = found.select("row", "hits").join(small(sample), "row").join(beyond, "row", "left")
    return own.orderBy("row").select("votes", "hits", F.coalesce("beyond", F.lit(0.0)).alias("beyond")).collect()
