"""Operator 7: a quality classifier from weak labels.

Heuristic labellers vote on each text: accept, reject or abstain. There are
two groups, on form (symbols, repetition, case, word length, function words,
repeated lines) and on abuse (lists of words and of word starts learned from a
bounded sample of labelled rows). For each group, expectation-maximisation over
the counts of all vote patterns of the corpus estimates how often each labeller
is right in either class and gives every pattern a posterior; the posteriors
are held to the constraint that silence is no evidence against a text
(posterior regularisation: Ganchev et al., 2010). Posteriors are the labels of a hashed linear scorer: its
features are hashed words, word starts and bucketed measures, chosen by how
far their frequencies differ between the classes and fitted by logistic
regression on a bounded sample. The scorer decides; the posteriors do not.

Bounds: at most per_class labelled rows of each class (by a hash of the id)
teach the word lists; at most per_side documents on each side of posterior 1/2
(by a hash of the id) train a scorer. The driver gathers what these rows'
chosen features need, the words of the lists, and the counts of vote patterns,
of which there are at most 3 to the number of labellers; feature frequencies
are summed by the executors.

Edge cases: null, empty and blank texts have no words, so all labellers
abstain and the scorer sees its bucketed measures only: they are kept unless
texts like them were rejected; null labels are ignored and a table of labels
without rows leaves the learned lists empty; repeated rows are scored each;
of rows that
repeat an id one trains; texts are never cut; an empty table gives an empty result. Columns other than
id and text are passed on by keep_accepted and ignored by classify.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from math import exp
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provspark.llm.common import in_parts, materialize

PER_CLASS, PER_SIDE = 4_000, 6_000
BINS = 1 << 18
#: Rows whose gradient is worked out at once.
BLOCK = 500
ABSTAIN, ACCEPT, REJECT = 0, 1, 2
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word starts.
STARTS = (4, 5)

# Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to a in is that it for was with as by be are this on an at or from le la de et les des en un une du que pour dans par sur avec "
    "der die und das den von zu mit sich dem auf für ist im nicht ein eine el los se del las por con su para es al".split()
)


@dataclass
class Lexicons:
    words: frozenset[str] = frozenset()
    starts: frozenset[str] = frozenset()


@dataclass
class Measured:
    """What labellers and features need of one text; tokens are lower-cased and may carry punctuation."""

    n: int
    tokens: list[str]
    symbols: float = 0.0
    upper: float = 0.0
    distinct: float = 1.0
    adjacent: float = 0.0
    mean_length: float = 0.0
    function: float = 0.0
    repeated_lines: float = 0.0
    marked: float = 0.0


def measure(text: str | None) -> Measured:
    tokens = (text or "").split()
    n = len(tokens)
    if not n:
        return Measured(0, [])
    low = text.lower().split()
    size = sum(map(len, tokens))
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    return Measured(
        n,
        low,
        sum(map(text.count, "#*$%&|<>!{}[]=~^\\")) / n,
        sum(map(len, filter(str.isupper, tokens))) / size,
        len(set(tokens)) / n,
        sum(map(eq, tokens, islice(tokens, 1, None))) / n,
        size / n,
        sum(map(FUNCTION_WORDS.__contains__, low)) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        tokens.count("|") / n,
    )


def words_in(tokens) -> set[str]:
    return {w for t in set(tokens) for w in WORD.findall(t)}


class TokenHits(dict):
    """Of a token: its learned words and learned starts, in one number; bounded."""

    def __init__(self, lex: Lexicons) -> None:
        super().__init__()
        self.lex = lex

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = 0
        for w in [token] if token.isalpha() else WORD.findall(token):
            out += w in self.lex.words
            for k in STARTS:
                if len(w) > k and w[:k] in self.lex.starts:
                    out += 1 << 32
        self[token] = out
        return out

    def of(self, tokens: list[str]) -> tuple[int, int]:
        total = sum(map(self.__getitem__, tokens))
        return total & 0xFFFFFFFF, total >> 32


def form_votes(m: Measured) -> list[int]:
    """Seven labellers that reject or abstain, and one that accepts what is ordinary in every measure."""
    if m.n < 3:
        return [ABSTAIN] * (N_FORM)
    long = m.n >= 40
    rejects = [
        m.symbols > 0.5,
        m.upper > 0.5,
        m.n >= 8 and m.adjacent > 0.2,
        long and m.distinct < 0.25,
        long and m.function < 0.03,
        long and m.repeated_lines > 0.4,
        m.n >= 8 and m.marked > 0.15,
    ]
    ordinary = m.symbols < 0.3 and m.upper < 0.35 and m.adjacent < 0.1 and m.repeated_lines < 0.3 and m.marked < 0.05 and not (long and (m.distinct < 0.3 or m.function < 0.05))
    return [REJECT if x else ABSTAIN for x in rejects] + [ACCEPT if ordinary else ABSTAIN]


def abuse_votes(m: Measured, lists: TokenHits) -> list[int]:
    """Two labellers that reject, by their share of words, or abstain, and one that accepts what is free of them."""
    if not m.n:
        return [ABSTAIN] * N_ABUSE
    hits = lists.of(m.tokens)
    return [REJECT if x >= 2 and 125 * x >= m.n else ABSTAIN for x in hits] + [ACCEPT if 250 * max(hits) < m.n else ABSTAIN]


N_FORM, N_ABUSE = 8, 3


def code_of(votes: list[int]) -> int:
    out = 0
    for v in reversed(votes):
        out = 3 * out + v
    return out


def votes_of(code: int, n: int) -> list[int]:
    return [code // 3**i % 3 for i in range(n)]


def estimate(patterns: dict[int, int], n: int, rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of rejection for each vote pattern, and P(vote | class) as [class, labeller, vote].

    Dawid-Skene with two classes and three votes; starts from the share of
    rejecting votes among those cast. After each estimate the posteriors are
    projected on a constraint: 0.2 at most for a text that no labeller rejects,
    so that silence cannot form the second class.
    """
    codes = sorted(patterns)
    if not codes:
        return {}, np.full((2, n, 3), 1 / 3)
    votes = np.array([votes_of(c, n) for c in codes])
    weight = np.array([patterns[c] for c in codes], float)
    cast = (votes != ABSTAIN).sum(axis=1)
    post = np.clip(np.where(cast > 0, (votes == REJECT).sum(axis=1) / np.maximum(cast, 1), 0.2), 0.02, 0.98)
    given = np.zeros((2, n, 3))
    for _ in range(rounds):
        before = post
        side = np.stack([1 - post, post]) * weight
        for v in range(3):
            given[:, :, v] = side @ (votes == v) + 0.1
        given /= given.sum(axis=2, keepdims=True)
        prior = (side.sum(axis=1) + 1) / (weight.sum() + 2)
        score = np.log(prior)[:, None] + np.log(given[:, np.arange(n)[:, None], votes.T]).sum(axis=1)
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -500, 500)))
        post = np.where((votes == REJECT).any(axis=1), post, np.minimum(post, 0.2))
        if np.abs(post - before).max() < 1e-9:
            break
    return dict(zip(codes, post.tolist(), strict=True)), given


def bin_of(name: str) -> int:
    return xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) & (BINS - 1)


def bins_of(token: str) -> list[int]:
    """The bins of a token's words and of their starts."""
    out = []
    for w in [token] if token.isalpha() else WORD.findall(token):
        out.append(bin_of("w:" + w))
        out += [bin_of("s:" + w[:k]) for k in STARTS if len(w) > k]
    return out


def measure_bins(m: Measured) -> list[int]:
    """The bins of a text's bucketed measures."""
    grades = {
        "symbols": (m.symbols, (0.02, 0.1, 0.3, 0.5, 1.0)),
        "upper": (m.upper, (0.1, 0.2, 0.35, 0.5, 0.8)),
        "adjacent": (m.adjacent, (0.01, 0.05, 0.1, 0.2, 0.5)),
        "distinct": (m.distinct, (0.1, 0.25, 0.3, 0.45, 0.7)),
        "function": (m.function, (0.01, 0.03, 0.05, 0.12)),
        "lines": (m.repeated_lines, (0.01, 0.1, 0.3, 0.4)),
        "marked": (m.marked, (0.005, 0.05, 0.15, 0.3)),
        "length": (m.mean_length, (3, 4, 6, 9, 14)),
    }
    size = sum(m.n >= x for x in (3, 8, 40))
    return [_grade_bin(name, sum(value >= c for c in cuts), size) for name, (value, cuts) in grades.items()]


@lru_cache(4096)
def _grade_bin(name: str, grade: int, size: int) -> int:
    return bin_of(f"{name}:{grade}:{size}")


def features(m: Measured) -> np.ndarray:
    """(bin, value) rows for training: words and starts by their number in 100 tokens, measures as 1."""
    found: dict[int, float] = {}
    each = 100 / max(m.n, 1)
    for token, k in Counter(m.tokens).items():
        for b in bins_of(token):
            found[b] = found.get(b, 0.0) + k * each
    found |= dict.fromkeys(measure_bins(m), 1.0)
    out = np.empty((len(found), 2), np.float32)
    out[:, 0] = list(found)
    out[:, 1] = np.minimum(list(found.values()), 20.0)  # keeps training steady; scores are plain sums
    return out


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float


class TokenWeights(dict):
    """The weights of a token in both scorers, as one complex number; bounded."""

    def __init__(self, form: Scorer, abuse: Scorer) -> None:
        super().__init__()
        both = form.weights.astype(np.complex128) + 1j * abuse.weights
        used = np.flatnonzero(both)
        self.both = dict(zip(used.tolist(), both[used].tolist(), strict=True))
        self.bias = complex(form.bias, abuse.bias)

    def __missing__(self, token: str) -> complex:
        if len(self) > 300_000:
            self.clear()
        of = self.both.get
        self[token] = out = sum([of(b, 0j) for b in bins_of(token)], 0j)
        return out

    def score(self, m: Measured) -> tuple[float, float]:
        """(form, abuse) scores of a text."""
        total = self.bias + sum([self.both.get(b, 0j) for b in measure_bins(m)], 0j)
        if m.n:
            total += sum(map(self.__getitem__, m.tokens)) * 100 / m.n
        return tuple(1 / (1 + exp(-max(min(x, 500.0), -500.0))) for x in (total.real, total.imag))


def choose(pos: np.ndarray, neg: np.ndarray, a: int, b: int) -> np.ndarray:
    """The bins whose frequencies in a rejected and b other texts differ clearly."""
    p, q = (pos + 0.5) / (a + 1), (neg + 0.5) / (b + 1)
    z = (p - q) / np.sqrt(p * (1 - p) / max(a, 1) + q * (1 - q) / max(b, 1) + 1e-12)
    return (np.abs(z) > 4) & (pos + neg >= 5)


def train(rows: list[np.ndarray], target: np.ndarray, chosen: np.ndarray, prior: float = 0.5, rounds: int = 400, most: float = 8.0) -> Scorer:
    """Logistic regression on the chosen bins; rows hold no others.

    Both classes weigh the same in training; the bias is then moved to the
    corpus' share of rejected texts (prior), by no more than a factor of
    `most`: so much dearer is a rejected text that stays than a good one that
    goes.
    """
    hard = target > 0.5
    if not rows or not hard.any():
        return Scorer(np.zeros(BINS, np.float32), -20.0)
    a, b = max(hard.sum(), 1), max((~hard).sum(), 1)
    number, width = (np.cumsum(chosen) - 1).astype(np.int32), int(chosen.sum())
    blocks = []  # of some rows each, so that what a step makes stays small
    for k in range(0, len(rows), BLOCK):
        part = rows[k : k + BLOCK]
        own = np.repeat(np.arange(len(part), dtype=np.int32), [len(r) for r in part])
        both = np.concatenate(part)
        blocks.append((slice(k, k + len(part)), own, number[both[:, 0].astype(np.int32)], both[:, 1].copy()))
    w, bias = np.zeros(width), 0.0
    share = np.where(hard, 0.5 / a, 0.5 / b)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):  # full-batch Adam
        grad = np.append(2e-5 * w, 0.0)
        for at, own, cols, value in blocks:
            logit = np.bincount(own, w[cols] * value, at.stop - at.start) + bias
            error = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - target[at]) * share[at]
            grad[:-1] += np.bincount(cols, error[own] * value, width)
            grad[-1] += error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    full = np.zeros(BINS, np.float32)
    full[chosen] = w
    return Scorer(full, float(bias + np.clip(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)), -np.log(most), 0)))


def _terms(toxic: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                unique = words_in((text or "").lower().split())
                counts[toxic[i]].update({f"w:{w}" for w in unique} | {f"s:{w[:k]}" for w in unique for k in STARTS if len(w) > k})
        for side, found in counts.items():
            items = list(found.items())
            for k in range(0, len(items), 65536):
                part = items[k : k + 65536]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in part]), pa.array([x[1] * side for x in part], pa.int64()), pa.array([x[1] * (1 - side) for x in part], pa.int64())],
                    ["term", "a", "b"],
                )

    return run


def pick(docs: DataFrame, ids: list) -> DataFrame:
    """The rows of docs with one of few ids, found without moving the texts."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    few = spark.createDataFrame([(i,) for i in ids], f"doc_id {kind}")
    return docs.join(F.broadcast(few), "doc_id", "left_semi")


def draw(column: str, salt: str):
    return F.pmod(F.xxhash64(F.lit(salt), column), F.lit(1 << 30)) / float(1 << 30)


def lexicons(docs: DataFrame, labels: DataFrame, per_class: int) -> Lexicons:
    """Words and word starts that mark labelled abuse."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic")
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return Lexicons()
    rows = []
    for side, n in sizes.items():
        part = known.where((F.col("toxic") == side) & (draw("doc_id", "labels") < per_class / n))
        rows += part.orderBy(draw("doc_id", "labels"), "doc_id").limit(per_class).collect()
    toxic = {r["doc_id"]: int(r["toxic"]) for r in rows}
    found = pick(docs, list(toxic)).mapInArrow(in_parts(_terms(toxic)), "term string, a long, b long")
    a, b = (max(sum(v == s for v in toxic.values()), 1) for s in (1, 0))
    total = found.groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = (F.col("a") / a) / (F.col("b") / b + 0.0005)
    terms = [r["term"] for r in total.where((F.col("a") >= max(4, a // 100)) & (odds >= 12)).select("term").collect()]
    return Lexicons(frozenset(t[2:] for t in terms if t[0] == "w"), frozenset(t[2:] for t in terms if t[0] == "s"))


def _vote(lex: Lexicons):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = TokenHits(lex)
        for b in batches:
            rows = [measure(t) for t in b.column(1).to_pylist()]
            form = pa.array([code_of(form_votes(m)) for m in rows], pa.int32())
            abuse = pa.array([code_of(abuse_votes(m, lists)) for m in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), form, abuse], ["doc_id", "form", "abuse"])

    return run


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [features(measure(t)).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["doc_id", "bins", "post"])


def as_rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float32).reshape(-1, 2) for x in column.to_pylist()]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts of either side have each bin."""
    sums = np.zeros((2, BINS), np.int64)
    for b in batches:
        for r, post in zip(as_rows(b.column(1)), b.column(2).to_pylist(), strict=True):
            sums[int(post > 0.5), r[:, 0].astype(np.int64)] += 1
    used = np.flatnonzero(sums.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[1, used]), pa.array(sums[0, used])], ["bin", "pos", "neg"])


def _only(chosen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r[chosen.value[r[:, 0].astype(np.int64)]].tobytes() for r in as_rows(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary()), b.column(2)], ["doc_id", "bins", "post"])

    return run


def fit_scorer(docs: DataFrame, posts: dict, prior: float) -> Scorer:
    """A scorer from the texts of few ids with their posteriors."""
    nothing = np.zeros(BINS, bool)
    if not posts:
        return train([], np.zeros(0), nothing)
    spark, kind = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    few = spark.createDataFrame(list(posts.items()), f"doc_id {kind}, post double")
    schema = f"doc_id {kind}, bins binary, post double"
    found = docs.join(F.broadcast(few), "doc_id").select("doc_id", "text", "post").mapInArrow(in_parts(_features), schema)
    # of rows that repeat an id one counts, so that their number is bounded
    found = materialize(found.groupBy("doc_id").agg(F.min("bins").alias("bins"), F.first("post").alias("post")), "features")
    sums = found.mapInArrow(_sums, "bin int, pos long, neg long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.zeros(BINS), np.zeros(BINS)
    at = np.asarray(sums.column("bin").combine_chunks(), np.int64)
    pos[at], neg[at] = np.asarray(sums.column("pos").combine_chunks()), np.asarray(sums.column("neg").combine_chunks())
    hard = sum(p > 0.5 for p in posts.values())
    chosen = choose(pos, neg, hard, len(posts) - hard)
    got = found.mapInArrow(_only(spark.sparkContext.broadcast(chosen)), schema).toArrow().sort_by("doc_id")  # so that reruns agree
    rows = [np.frombuffer(x.as_buffer(), np.float32).reshape(-1, 2) for x in got.column("bins")]
    return train(rows, np.array(got.column("post").to_pylist()), chosen, prior)


@dataclass
class Model:
    form: Scorer
    abuse: Scorer
    #: P(vote | class) of the labellers, for reports.
    form_votes: np.ndarray
    abuse_votes: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, per_side: int = PER_SIDE) -> Model:
    """docs: (doc_id, text). labels: (doc_id, toxic)."""
    kind = dict(docs.dtypes)["doc_id"]
    lex = lexicons(docs, labels, per_class)
    votes = materialize(docs.mapInArrow(in_parts(_vote(lex)), f"doc_id {kind}, form int, abuse int"), "votes")
    scorers, given = {}, {}
    for name, n in (("form", N_FORM), ("abuse", N_ABUSE)):
        counts = {r[name]: r["count"] for r in votes.groupBy(name).count().collect()}
        post, given[name] = estimate(counts, n)
        prior = sum(n * (post[c] > 0.5) for c, n in counts.items()) / max(sum(counts.values()), 1)
        sides = [[c for c in counts if (post[c] > 0.5) == side] for side in (False, True)]
        chosen: dict = {}
        for codes in sides:
            total = sum(counts[c] for c in codes)
            if not total:
                continue
            part = votes.where(F.col("doc_id").isNotNull() & F.col(name).isin(codes) & (draw("doc_id", name) < 1.2 * per_side / total))
            rows = part.select("doc_id", name).orderBy(draw("doc_id", name), "doc_id").limit(per_side).collect()
            chosen |= {r["doc_id"]: post[r[name]] for r in rows}
        scorers[name] = fit_scorer(docs, chosen, prior)
    return Model(scorers["form"], scorers["abuse"], given["form"], given["abuse"])


def _score(model, text_at: int, only_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = TokenWeights(model.value.form, model.value.abuse)
        for b in batches:
            scores = [weights.score(measure(t)) for t in b.column(text_at).to_pylist()]
            form, abuse = np.array([x[0] for x in scores]), np.array([x[1] for x in scores])
            accepted = pa.array((form <= 0.5) & (abuse <= 0.5), pa.bool_())
            if only_kept:
                yield b.filter(accepted)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(form), pa.array(abuse), accepted], ["doc_id", "form_score", "abuse_score", "accepted"])

    return run


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, bounds: dict):
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows, docs.sparkSession.sparkContext.broadcast(fit(rows, labels, **bounds))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """One row per document: (doc_id, form_score, abuse_score, accepted)."""
    rows, model = _fitted(docs, labels, id_col, text_col, bounds)
    kind = dict(docs.dtypes)[id_col]
    return rows.mapInArrow(in_parts(_score(model, 1, False)), f"doc_id {kind}, form_score double, abuse_score double, accepted boolean")


def keep_accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns."""
    _, model = _fitted(docs, labels, id_col, text_col, bounds)
    return docs.mapInArrow(in_parts(_score(model, docs.columns.index(text_col), True)), docs.schema)
