"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters are words (lexicon) and word beginnings (patterns) that go with toxic labels in a bounded sample of the
   training labels, and a short list of common insults. A voter votes by how often it occurs: once, twice, up to LEVELS
   times; without an occurrence it abstains. Every voter with evidence is kept; of names that contain each other, the
   one with most evidence. Near copies of a labelled text count once.
2. The label model assumes that voters vote independently given the unseen label, but for the pairs that it finds
   correlated. Covariances of independent voters are then products of one number per voter, which the model reads
   off the covariance matrix of the votes on ALL documents (median over triples); with the prior that gives each
   vote's rate on toxic and on clean texts. Where too few voters agree with one (a language with two patterns), its rates on
   labelled rows stand in. Pairs whose covariance departs from the product are taken as correlated, left out of the
   triples, and share their weight in the posterior.
3. A logistic regression is trained on the posteriors of a bounded sample of documents and scores every text. It sees
   the votes, their sum and density, and beyond them the densities of hashed words.

What the driver gathers is bounded by the parameters below: counts of names in the labelled sample, covariances of
voters (which evidence in that sample bounds), the training sample.

Cases: null and empty texts have no votes and get the classifier's score for none; repeated rows are scored one by
one; without labels, or where no word stands out, the insults alone vote; a doc_id with several labels is toxic if
one of them says so; an input column `score` gives way, all other columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import tables, texts, written
from .textblocks import ALNUM_DELIMITED, blocks, grams

#: Labelled rows from which voters are chosen, and documents on which the classifier is trained, at most about.
LABELLED_SAMPLE = 20_000
TRAINING_SAMPLE = 20_000
#: Least log-likelihood ratio statistic of a voter, least number of toxic texts that it must stand in. With M names to
#: choose from, chance alone makes a statistic of about 2 ln M; a voter's must be above that as well.
EVIDENCE, LEAST = 15.0, 3
#: Occurrences that make votes of their own.
LEVELS = 4
#: Bounds of the density of votes, in votes per 100 words, which is a voter itself.
DENSITIES = (0.0, 0.25, 0.75, 1.5, 3.0)
#: Lengths of word beginnings that can be patterns.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Names that a worker counts before it hands them on.
NAMES_HELD = 50_000
#: Buckets of hashed words that the classifier sees.
HASHED = 256
#: Insults that vote whatever the labels say.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
#: Rates of an insult on toxic and on clean texts before any is seen.
INSULT_RATES = (0.05, 0.001)
#: Prior share of toxic texts where there are no labels.
PRIOR = 0.05

_WORD = re.compile(r"[^\W_]+")


class Voter(NamedTuple):
    """A word, or a beginning (marked by a trailing *), and the labelled toxic and clean texts with 1, 2, ... occurrences or more."""

    name: str
    toxic: tuple[int, ...]
    clean: tuple[int, ...]


class Chosen(NamedTuple):
    """Voters by falling evidence, labelled toxic and clean texts, the share of toxic labels, texts by density of votes.

    dense: toxic and clean labelled texts by density of all votes, none first.
    """

    voters: list[Voter]
    toxic: int
    clean: int
    prior: float
    dense: np.ndarray


class Model(NamedTuple):
    """Names of voters, weights of their votes (voter, level from 0) and of their density, correlated pairs, the classifier."""

    voters: tuple[str, ...]
    votes: np.ndarray
    dense: np.ndarray
    pairs: tuple[tuple[int, int], ...]
    weights: np.ndarray
    bias: float


def training_rows(labels: DataFrame) -> DataFrame:
    """doc_id, toxic of the labels that may be learnt from: crc32 of the id as text is not 2 modulo 4."""
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).na.drop()
    return kept.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def held_out(doc_id: str) -> F.Column:
    """Whether a document's label is kept for measuring."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _evidence(a: str, b: str, toxic: int, clean: int) -> F.Column:
    """Log-likelihood ratio statistic of a name in a of the toxic and b of the clean texts; 0 if it favours clean or is rare."""
    total, n = toxic + clean, F.col(a) + F.col(b)
    cells = ((F.col(a), n * toxic / total), (F.col(b), n * clean / total), (toxic - F.col(a), (total - n) * toxic / total), (clean - F.col(b), (total - n) * clean / total))
    parts = [F.when((o > 0) & (e > 0), 2 * o * F.ln(o / e)).otherwise(0.0) for o, e in cells]
    whole = parts[0] + parts[1] + parts[2] + parts[3]
    return F.when((F.col(a) < LEAST) | (F.col(a) * clean <= F.col(b) * toxic), 0.0).otherwise(whole)


def _named(text: str | None) -> Counter[str]:
    """Occurrences of every word and beginning."""
    out: Counter[str] = Counter()
    for w, n in Counter(_WORD.findall((text or "").lower())).items():
        out[w] += n
        for k in PREFIXES:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, float | None]:
    """text, toxic of at most `sample` training rows, and the share of toxic labels; of near copies that are toxic one stays.

    Toxic texts that agree in the least hash of their runs of three words count as copies. Clean ones all count: they
    only speak against a voter.
    """
    train = training_rows(labels)
    share = train.agg(F.avg("toxic").alias("p")).first().p
    chosen = F.broadcast(train.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # `sample` rows at most
    own = texts(docs).join(chosen, "doc_id").select("text", "toxic")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=np.int64)
            for block in blocks(batch.column(0), ALNUM_DELIMITED):
                for i in range(block.n):
                    h = block.hashes[block.bounds[i] : block.bounds[i + 1]]
                    g = grams(h, min(3, len(h))) if len(h) else np.zeros(1, dtype=np.uint64)
                    found[block.first + i] = g.min().astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["text", "toxic", "copy"])

    hostile = own.where("toxic = 1").mapInArrow(signed, "text string, toxic int, copy long").groupBy("copy").agg(F.min("text").alias("text"))
    return written(hostile.select("text", F.lit(1).alias("toxic")).unionByName(own.where("toxic <> 1")), "labelled"), share


def choose_voters(docs: DataFrame, labels: DataFrame, sample: int = LABELLED_SAMPLE) -> Chosen:
    """Chooses voters from at most `sample` labelled rows."""
    labelled, share = _labelled(docs, labels, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def gathered() -> pa.RecordBatch:
            values = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2 * LEVELS)
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array(c) for c in values.T)], names=["name", *columns])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, n in [("", 1), *_named(text).items()]:
                    at = seen.setdefault(name, [0] * (2 * LEVELS))
                    for level in range(min(n, LEVELS)):
                        at[LEVELS * bool(toxic) + level] += 1
                if len(seen) >= NAMES_HELD:  # Spark adds them up, so that a worker's memory does not grow with its rows
                    yield gathered()
                    seen.clear()
        yield gathered()

    columns = [f"{kind}{level}" for kind in ("clean", "toxic") for level in range(1, LEVELS + 1)]
    counts = labelled.mapInArrow(count, ", ".join(["name string", *(f"{c} long" for c in columns)]))
    counts = written(counts.groupBy("name").agg(*(F.sum(c).alias(c) for c in columns)), "names")
    totals = counts.where("name = ''").first()
    toxic, clean = (totals.toxic1, totals.clean1) if totals else (0, 0)
    # what is as common on clean texts cannot have evidence
    seen_often = counts.where((F.col("name") != "") & (F.col("toxic1") + F.col("clean1") >= LEAST)).count()
    bound, ranked = max(EVIDENCE, 2 * np.log(max(seen_often, 1))), []
    best = F.greatest(*(_evidence(f"toxic{v}", f"clean{v}", toxic, clean) for v in range(1, LEVELS + 1))) if toxic and clean else F.lit(0.0)
    for r in counts.where(F.col("name") != "").withColumn("best", best).where(F.col("best") >= bound).collect():  # bounded by the sample's size
        own = (tuple(r[f"{kind}{v}"] for v in range(1, LEVELS + 1)) for kind in ("toxic", "clean"))
        ranked.append((r.best, not r.name.endswith("*"), len(r.name), Voter(r.name, *own)))
    # equal evidence: the whole word, else the longer beginning
    taken, inside, voters = set(), set(), []
    for _, _, _, voter in sorted(ranked, key=lambda x: (-x[0], not x[1], -x[2], x[3].name)):
        stem = voter.name.rstrip("*")
        begins = {stem[:k] + "*" for k in PREFIXES if len(stem) > k} | {stem + "*"}
        if begins & taken or voter.name in inside or stem in taken:
            continue
        voters.append(voter)
        taken.add(voter.name)
        inside |= begins
    known, none = {v.name for v in voters}, (0,) * LEVELS
    voters += [Voter(w, none, none) for w in INSULTS if w not in known and not any(w[:k] + "*" in known for k in PREFIXES)]

    dense = np.zeros((2, len(DENSITIES) + 1))
    for r in labelled.mapInArrow(_density_counter([v.name for v in voters]), "toxic int, dense int").groupBy("toxic", "dense").count().collect():
        dense[int(r.toxic != 1), r.dense] = r["count"]
    return Chosen(voters, toxic, clean, min(max(float(share), 0.01), 0.5) if share is not None else PRIOR, dense)


def _density_counter(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(names)
        for batch in batches:
            total, words = votes.levels(batch.column(0).to_pylist())[:, -1], _words(batch.column(0))[0]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(density_level(total, words).astype(np.int32))], names=["toxic", "dense"])

    return run


def density_level(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 without votes, else 1 and one more for each of DENSITIES but the first that votes per 100 words reach."""
    return (100 * total[:, None] / np.maximum(words, 1)[:, None] >= np.array(DENSITIES[1:])).sum(axis=1) * (total > 0) + (total > 0)


def _words(column: pa.Array, buckets: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many fall into each of so many hash buckets."""
    words, hashed = np.zeros(len(column)), np.zeros((len(column), buckets))
    for block in blocks(column, ALNUM_DELIMITED):
        for i in range(block.n):
            h = block.hashes[block.bounds[i] : block.bounds[i + 1]]
            words[block.first + i] = len(h)
            hashed[block.first + i] = np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    return words, hashed


class Votes:
    """Counts voters in texts."""

    def __init__(self, voters: list[str] | tuple[str, ...]):
        self.n = len(voters)
        self.at = {v: i for i, v in enumerate(voters)}
        whole = sorted((re.escape(v) for v in voters if not v.endswith("*")), reverse=True)
        begun = sorted((re.escape(v[:-1]) for v in voters if v.endswith("*")), key=len, reverse=True)
        parts = [rf"({'|'.join(whole)})(?![^\W_])"] * bool(whole) + [rf"({'|'.join(begun)})"] * bool(begun)
        first = "".join(sorted({re.escape(v[0]) for v in voters}))
        self.find = re.compile(rf"(?<![^\W_])(?=[{first}])(?:{'|'.join(parts)})")
        self.marks = [""] * bool(whole) + ["*"] * bool(begun)

    def counts(self, text: str | None) -> dict[int, int]:
        out: Counter[int] = Counter()
        for m in self.find.finditer((text or "").lower()):
            out[self.at[m[m.lastindex] + self.marks[m.lastindex - 1]]] += 1
        return out

    def levels(self, rows: list[str | None]) -> np.ndarray:
        """Occurrences of each voter in each text, LEVELS at most; a last column has all occurrences."""
        x = np.zeros((len(rows), self.n + 1), dtype=np.int64)
        for i, text in enumerate(rows):
            found = self.counts(text)
            if found:
                x[i, list(found)] = np.minimum(list(found.values()), LEVELS)
                x[i, -1] = sum(found.values())
        return x


def vote_moments(docs: DataFrame, voters: list[str]) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each pair of voters votes (the diagonal: each voter), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, n, both = Votes(voters), 0, np.zeros((len(voters), len(voters)), dtype=np.int64)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).to_pylist():
                if found := list(votes.counts(text)):
                    both[np.ix_(found, found)] += 1
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1)), pa.array(np.append(j, -1)), pa.array(np.append(both[i, j], n))], names=["i", "j", "n"])

    found = texts(docs).select("text").mapInArrow(count, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    total, both = 0, np.zeros((len(voters), len(voters)), dtype=np.int64)
    for r in found:
        if r.i < 0:
            total = r.n
        else:
            both[r.i, r.j] = r.n
    return total, both


def label_model(n: int, both: np.ndarray, prior: float, seen: np.ndarray, rows: tuple[int, int], before: np.ndarray | float = 0.5) -> tuple[np.ndarray, tuple[tuple[int, int], ...]]:
    """Rates at which each voter votes on toxic and on clean texts, and the correlated pairs.

    The rates come from agreement on all documents, inside the range that labels leave open: seen has the labelled
    toxic and clean texts with a vote, rows how many there are, and a rate may depart by the factor exp(2 / sqrt(count + 1))
    of two standard errors. A language goes along with its voters, so agreement alone takes them for
    better than they are. Voters that agree with fewer than two others keep the labelled rates. before: rates that
    stand for one row more of each label.
    """
    v = len(both)
    mean = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(mean, mean)
    linked = np.eye(v, dtype=bool)
    factor, agreed = np.zeros(v), np.zeros(v, dtype=bool)
    for _ in range(3):
        for i in range(v):
            good = np.flatnonzero(~linked[i] & (mean > 0))
            agreed[i] = False
            if len(good) < 2 or not mean[i]:
                continue
            top = cov[i, good][:, None] * cov[i, good][None, :]
            low = cov[np.ix_(good, good)]
            use = (low > 0) & (cov[i, good][:, None] > 0) & (cov[i, good][None, :] > 0) & ~linked[np.ix_(good, good)]
            if use.any():
                factor[i], agreed[i] = np.sqrt(np.median(top[use] / low[use])), True
        spread = np.sqrt(np.outer(mean, mean) / max(n, 1)) + 1e-12
        product = np.outer(factor, factor)
        linked = (np.abs(cov - product) > np.maximum(6 * spread, product)) & agreed[:, None] & agreed[None, :] | np.eye(v, dtype=bool)
    gap = factor / np.sqrt(prior * (1 - prior))
    model = np.stack([mean + (1 - prior) * gap, mean - prior * gap], axis=1)
    labelled, room = (seen + before) / (np.array(rows) + 1.0), np.exp(2 / np.sqrt(seen + 1.0))
    rates = np.where(agreed[:, None], np.clip(model, labelled / room, labelled * room), labelled)
    linked[np.diag_indices(v)] = False
    return np.clip(rates, 1e-6, 0.99), tuple((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(linked)), strict=True))


def vote_weights(rates: np.ndarray, voters: list[Voter]) -> np.ndarray:
    """Log of how much likelier each number of occurrences is in a toxic text, by voter and level: 0, 1, ... LEVELS or more.

    The rates say how often a voter votes, labelled texts how often its votes have just so many occurrences. So a
    beginning that stands once in clean texts and often in toxic ones speaks against toxic where it stands once. An
    abstention weighs nothing (the voter may belong to another language).
    """
    out = np.zeros((len(voters), LEVELS + 1))
    for i, v in enumerate(voters):
        shares = []
        for at_least in (np.array(v.toxic), np.array(v.clean)):
            just = at_least - np.append(at_least[1:], 0)
            shares.append((just + 1 / LEVELS) / (at_least[0] + 1))
        out[i, 1:] = np.log(rates[i, 0] / rates[i, 1]) + np.log(shares[0] / shares[1])
    return out


def density_weights(dense: np.ndarray) -> np.ndarray:
    """Weight of each density of votes, given that there are votes: where toxic texts have many, few speak against it."""
    smoothed = dense[:, 1:] + 0.5
    return np.append(0.0, np.log(smoothed[0] / smoothed[0].sum()) - np.log(smoothed[1] / smoothed[1].sum()))


def log_odds(levels: np.ndarray, votes: np.ndarray, pairs: tuple[tuple[int, int], ...]) -> np.ndarray:
    """Sum of the weights of a row's votes; voters of a correlated pair share theirs where both vote."""
    weight = votes[np.arange(len(votes)), levels]
    share = np.ones(levels.shape)
    for a, b in pairs:
        share[:, [a, b]] += ((levels[:, a] > 0) & (levels[:, b] > 0))[:, None] * 0.5
    return (weight / share).sum(axis=1)


def posterior(odds: np.ndarray, levels: np.ndarray, prior: float, missed: float) -> np.ndarray:
    """Probability of toxic from summed weights; where all voters abstain, texts are toxic as often as toxic labels lack votes."""
    odds = np.log(prior / (1 - prior)) + odds
    none = prior * missed / (prior * missed + 1 - prior)
    return np.where((levels > 0).any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -30, 30))), none)


def _features(column: pa.Array, votes: Votes, weights: np.ndarray, dense: np.ndarray, pairs: tuple[tuple[int, int], ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Votes, their summed weights, and the classifier's inputs: votes, their weight, number and density, densities of hashed words."""
    levels = votes.levels(column.to_pylist())
    own, total = levels[:, :-1], levels[:, -1]
    words, hashed = _words(column, HASHED)
    hashed = np.sqrt(hashed / np.maximum(words, 1)[:, None])
    odds = log_odds(own, weights, pairs) + dense[density_level(total, words)]
    density = np.minimum(5.0, 100 * total / np.maximum(words, 1))
    more = np.stack([odds.clip(-15, 15) / 5, np.log1p(total), density, (own > 0).sum(axis=1)], axis=1)
    return own, odds, np.hstack([np.log2(1 + own), more, hashed])


#: Rows of a block in which the classifier's sums are worked out.
BLOCK_ROWS = 2000


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps with a ridge on the weights; block by block, to bound memory."""
    w = np.zeros(x.shape[1] + 1)
    hold = np.full(len(w), ridge * max(len(x), 1))
    hold[-1] = 1e-9
    for _ in range(steps):
        grad, curve = hold * w, np.diag(hold + 1e-6)
        for i in range(0, len(x), BLOCK_ROWS):
            z = np.hstack([x[i : i + BLOCK_ROWS], np.ones((len(x[i : i + BLOCK_ROWS]), 1))]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            grad = grad + z.T @ (p - y[i : i + BLOCK_ROWS])
            curve = curve + (z * (p * (1 - p))[:, None]).T @ z
        move = np.linalg.solve(curve, grad)
        w -= move * min(1.0, 4 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits voters, label model and classifier."""
    tables(docs.sparkSession)
    chosen = choose_voters(docs, labels)
    names = tuple(v.name for v in chosen.voters)
    n, both = vote_moments(docs, list(names))
    seen = np.array([(v.toxic[0], v.clean[0]) for v in chosen.voters], dtype=float)
    before = np.array([INSULT_RATES if v.name in INSULTS else (0.5, 0.5) for v in chosen.voters])
    rates, pairs = label_model(n, both, chosen.prior, seen, (chosen.toxic, chosen.clean), before)
    said, dense = vote_weights(rates, chosen.voters), density_weights(chosen.dense)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(names)
        for batch in batches:
            own, odds, x = _features(batch.column(0), votes, said, dense, pairs)
            y = posterior(odds, own, chosen.prior, (chosen.dense[0, 0] + 1) / (chosen.toxic + 2))
            packed = [row.tobytes() for row in x.astype(np.float32)]  # a few hundred numbers a row, of which the driver gets TRAINING_SAMPLE
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(packed, pa.binary())], names=["y", "x"])

    one_in = max(1, -(-n // TRAINING_SAMPLE))
    own = texts(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(one_in)) == 0).select("text")
    rows = own.mapInArrow(featurise, "y double, x binary").limit(2 * TRAINING_SAMPLE).collect()
    if not rows:
        return Model(names, said, dense, pairs, np.zeros(len(names) + 4 + HASHED), -3.0)
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float32).reshape(len(rows), -1)
    weights, bias = logistic(x, np.array([r.y for r in rows]))
    return Model(names, said, dense, pairs, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, 0 to 1, to all columns of the documents; a column of that name gives way."""
    tables(docs.sparkSession)
    docs = docs.drop("score")
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers for each voter

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        votes = Votes(m.voters)
        for batch in batches:
            x = _features(batch.column("text"), votes, m.votes, m.dense, m.pairs)[2] @ m.weights + m.bias
            arrays = [batch.column(n) for n in names] + [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30))))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The document rows, all columns, that score below the threshold."""
    return score(docs, fit(docs, labels)).where(F.col("score") < threshold).drop("score")
