"""Toxic spans by a linear-chain conditional random field.

Documents are labelled as a whole, so tokens are labelled first: a feature of a word (the word,
its beginnings and endings) marks a token as toxic if documents labelled toxic hold it far more
often than others and in several contexts, so that copies of one text count once. On these
labelled tokens a chain of two states is fitted: weights of the features of a token and of the
words beside it, and of the transitions. Forward-backward gives each token the probability of the
toxic state; a document's score comes from the largest of them and from their sum, by a logistic
fitted on the same documents. Spans of likely tokens are handed on with their offsets.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billgrain.llm.common import short_batches
from billgrain.llm.words import REMEMBERED, remembered

#: Labelled documents of each class that the fit takes at most, and characters that such a
#: document may have: the bound of the sample (40 million characters at the very most, usually a tenth).
SAMPLE, SAMPLE_CHARS = 1_000, 20_000
#: A marking feature: so many different contexts, and so much likelier in toxic documents.
CONTEXTS, ODDS = 5, 20.0
#: Lengths of beginnings and endings that count as features.
AFFIXES = (4, 5, 6)
#: Words on each side of a token that it sees.
SIDES = (-1, 1)
#: Rounds and rate of the fit, and its penalty on large weights.
ROUNDS, RATE, PENALTY = 60, 0.5, 1e-4
#: A token belongs to a span from this probability on.
LIKELY = 0.5
#: Texts scored at once.
TEXTS = 200

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[str]:
    """What is known of a token: the word without marks around it, its beginnings and endings."""
    plain = EDGE.sub("", word.lower())
    found = [plain]
    for n in AFFIXES:
        if len(plain) > n:
            found += [f"{plain[:n]}-", f"-{plain[-n:]}"]
    return found


def marginals(lift: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The log odds of the toxic state of each token, given its whole line.

    ``lift``: a token's log odds by its features; ``starts``: the first token of each line;
    ``moves[a, b]``: weights of going from state a to b. Lines are walked side by side, longest first.
    """
    n = len(lift)
    if not n:
        return np.zeros(0)
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    begin, size = starts[order], sizes[order]
    active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else []
    m, odds = np.exp(moves), np.exp(np.clip(lift, -30, 30))
    ahead, back = np.empty(n), np.empty(n)
    for t, count in enumerate(active):
        here = begin[:count] + t
        ahead[here] = odds[here] if t == 0 else odds[here] * (m[0, 1] + ahead[here - 1] * m[1, 1]) / (m[0, 0] + ahead[here - 1] * m[1, 0])
    for t in range(len(active) - 1, -1, -1):
        here = begin[: active[t]] + t
        last = size[: active[t]] == t + 1
        after = here[~last] + 1
        value = np.ones(len(here))
        seen = odds[after] * back[after]
        value[~last] = (m[1, 0] + m[1, 1] * seen) / (m[0, 0] + m[0, 1] * seen)
        back[here] = value
    return np.log(ahead) + np.log(back)


def lines_of(text: str) -> list[list[str]]:
    return [words for words in (TOKEN.findall(line) for line in text.split("\n")) if words]


def summary(log_odds: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """For each document: the largest log odds, and logarithms of the expected toxic tokens and of their share."""
    p = 1 / (1 + np.exp(-log_odds))
    top = np.full(n, -12.0)
    np.maximum.at(top, owner, np.clip(log_odds, -12, 12))
    expected, size = np.bincount(owner, p, n), np.bincount(owner, minlength=n)
    return np.stack([top, np.log(expected + 1e-3), np.log(100 * expected / np.maximum(size, 1) + 0.1)], axis=1)


@dataclass
class Model:
    """Weights by feature name; of a token's own features, and of the words beside it."""

    own: dict[str, float]
    beside: dict[int, dict[str, float]]
    bias: float
    moves: np.ndarray
    logistic: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def weights(self, word: str) -> tuple[float, ...]:
        found = features(word)
        return (self.bias + sum(self.own.get(f, 0.0) for f in found), *(self.beside[s].get(found[0], 0.0) for s in SIDES))

    def log_odds(self, split: list[list[str]], known: dict[str, tuple[float, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """The marginals of the tokens of all lines, and the lines' starts. ``known`` remembers words."""
        sizes = np.array([len(words) for words in split], np.int64)
        starts = np.cumsum(sizes) - sizes
        for word in set().union(*split).difference(known):
            known[word] = self.weights(word)
        n = int(sizes.sum())
        each = np.fromiter((known[w] for words in split for w in words), np.dtype((float, 1 + len(SIDES))), n)
        line = np.repeat(np.arange(len(sizes)), sizes)
        lift = each[:, 0].copy()
        for k, side in enumerate(SIDES):
            inside = np.flatnonzero(line[1:] == line[:-1]) + (1 if side < 0 else 0)
            lift[inside] += each[inside + side, 1 + k]
        return marginals(lift, starts, self.moves), starts

    def scores(self, facts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(facts @ self.logistic[1:] + self.logistic[0], -35, 35)))


@dataclass
class Sample:
    """Labelled documents as numbers of words; a word's features as numbers too."""

    words: list[str]
    code: np.ndarray  # of each token
    line: np.ndarray
    starts: np.ndarray  # of each line
    owner: np.ndarray  # the document of each token
    toxic: np.ndarray  # of each document
    names: list[str]  # of features
    of_word: np.ndarray  # words, and beside them ...
    feature: np.ndarray  # ... a feature that each has
    plain: np.ndarray  # the first feature of each word


def _sample(rows: list[tuple[str, bool]]) -> Sample:
    place: dict[str, int] = {}
    codes, sizes, tokens = [], [], []
    for text, _ in rows:
        lines = lines_of(text)
        codes.append(np.fromiter((place.setdefault(w, len(place)) for words in lines for w in words), np.int32))
        sizes += map(len, lines)
        tokens.append(len(codes[-1]))
    number: dict[str, int] = {}
    of_word, feature, plain = [], [], []
    for k, word in enumerate(place):
        found = [number.setdefault(f, len(number)) for f in dict.fromkeys(features(word))]
        of_word += [k] * len(found)
        feature += found
        plain.append(found[0])
    size = np.array(sizes, np.int64)
    return Sample(
        [*place],
        np.concatenate([*codes, np.zeros(0, np.int32)]),
        np.repeat(np.arange(len(size)), size),
        np.cumsum(size) - size,
        np.repeat(np.arange(len(rows)), tokens),
        np.array([toxic for _, toxic in rows], bool),
        [*number],
        np.array(of_word, np.int32),
        np.array(feature, np.int32),
        np.array(plain, np.int32),
    )


def marking_words(sample: Sample) -> np.ndarray:
    """Which words have a feature that tells toxic documents apart in enough different contexts."""
    held = np.unique(sample.owner * len(sample.words) + sample.code)  # the words of each document, once
    owner, code = held // max(len(sample.words), 1), held % max(len(sample.words), 1)
    by_word = np.argsort(sample.of_word, kind="stable")
    first = np.searchsorted(sample.of_word[by_word], np.arange(len(sample.words) + 1))
    count = (first[1:] - first[:-1])[code]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    pairs = np.unique(np.repeat(owner, count) * len(sample.names) + sample.feature[np.repeat(first[code], count) + inner])
    named, toxic = pairs % max(len(sample.names), 1), sample.toxic[pairs // max(len(sample.names), 1)]
    rate = lambda c: (np.bincount(named[toxic == c], minlength=len(sample.names)) + 0.5) / ((sample.toxic == c).sum() + 1)
    likely = rate(True) >= ODDS * rate(False)
    likely[[k for k, name in enumerate(sample.names) if not name]] = False
    # contexts are looked at only for those few
    has = likely[sample.feature]
    features_of = defaultdict(list)
    for word, name in zip(sample.of_word[has].tolist(), sample.feature[has].tolist()):
        features_of[word].append(name)
    contexts: dict[int, set] = defaultdict(set)
    wanted = np.zeros(len(sample.words), bool)
    wanted[list(features_of)] = True
    n = len(sample.code)
    for k in np.flatnonzero(wanted[sample.code] & sample.toxic[sample.owner]).tolist():
        before = int(sample.code[k - 1]) if k and sample.line[k - 1] == sample.line[k] else -1
        after = int(sample.code[k + 1]) if k + 1 < n and sample.line[k + 1] == sample.line[k] else -1
        for name in features_of[int(sample.code[k])]:
            contexts[name].add((before, after))
    marks = np.zeros(len(sample.names), bool)
    marks[[name for name, seen in contexts.items() if len(seen) >= CONTEXTS]] = True
    found = np.zeros(len(sample.words), bool)
    found[sample.of_word[marks[sample.feature]]] = True
    return found


def fit(rows: list[tuple[str, bool]]) -> Model:
    """The chain and the logistic from labelled texts. Without both classes everything scores near 0.

    Gradient ascent on the chain's likelihood, each weight with its own step (Adagrad). Tokens are
    summed up by word first, so a round costs a few passes over the tokens.
    """
    nothing = Model({}, {s: {} for s in SIDES}, -12.0, np.zeros((2, 2)), np.array([-12.0, 0, 0, 0]))
    data = _sample(rows)
    if len(set(data.toxic.tolist())) < 2:
        return nothing
    label = marking_words(data)[data.code] & data.toxic[data.owner]
    if not label.any():
        return nothing
    n, n_words, size = len(label), len(data.words), len(data.names)
    times = np.bincount(data.code, minlength=n_words)
    # features that too few tokens have cannot be told from chance
    often = np.bincount(data.feature, times[data.of_word], size) >= 3
    kept = often[data.feature]
    of_word, feature = data.of_word[kept], data.feature[kept]
    plain = np.where(often[data.plain], data.plain, size)  # one past the end: no feature
    same = np.flatnonzero(data.line[1:] == data.line[:-1])
    at = {-1: same + 1, 1: same}
    weights = {"own": np.zeros(size), **{s: np.zeros(size + 1) for s in SIDES}, "bias": np.full(1, -5.0), "moves": np.zeros((2, 2))}
    step = {k: np.full(v.shape, 1e-3) for k, v in weights.items()}
    a0, b0 = label[same].astype(int), label[same + 1].astype(int)
    seen = np.bincount(2 * a0 + b0, minlength=4).reshape(2, 2)
    for _ in range(ROUNDS):
        by_word = np.bincount(of_word, weights["own"][feature], n_words)
        lift = by_word[data.code] + weights["bias"][0]
        for side in SIDES:
            lift[at[side]] += weights[side][plain][data.code[at[side] + side]]
        p = 1 / (1 + np.exp(-marginals(lift, data.starts, weights["moves"])))
        error = label - p
        gradient = {"own": np.bincount(feature, np.bincount(data.code, error, n_words)[of_word], size), "bias": np.array([error.sum()])}
        for side in SIDES:
            gradient[side] = np.bincount(plain, np.bincount(data.code[at[side] + side], error[at[side]], n_words), size + 1)
            gradient[side][size] = 0
        m = np.exp(weights["moves"])
        a, b = p[same], p[same + 1]
        pair = np.stack([(1 - a) * (1 - b) * m[0, 0], (1 - a) * b * m[0, 1], a * (1 - b) * m[1, 0], a * b * m[1, 1]])
        gradient["moves"] = seen - (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
        for k, g in gradient.items():
            g = g / n - (PENALTY * 1e-2 * weights[k] if k != "bias" else 0)
            step[k] += 1e6 * g * g
            weights[k] += RATE * 1e3 * g / np.sqrt(step[k])
        weights["moves"] = np.clip(weights["moves"], -4, 4)
    large = lambda w: {data.names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w[:size]) > 1e-3)}
    model = Model(large(weights["own"]), {s: large(weights[s]) for s in SIDES}, float(weights["bias"][0]), weights["moves"], np.zeros(4))
    lift = np.bincount(of_word, weights["own"][feature], n_words)[data.code] + weights["bias"][0]
    for side in SIDES:
        lift[at[side]] += weights[side][plain][data.code[at[side] + side]]
    facts = summary(marginals(lift, data.starts, weights["moves"]), data.owner, len(rows))
    model.logistic = _logistic(facts, data.toxic.astype(float))
    return model


def _logistic(facts: np.ndarray, truth: np.ndarray, rounds: int = 50, penalty: float = 1.0) -> np.ndarray:
    """Weights by Newton steps, the intercept first; a penalty keeps separable data finite."""
    x = np.c_[np.ones(len(facts)), facts]
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [penalty * 1e-1] * facts.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        change = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (truth - p) - ridge @ w)
        w += change
        if np.abs(change).max() < 1e-8:
            break
    return w


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from at most ``SAMPLE`` documents of each class, taken by a digest of their ids.

    The sample comes to the driver: its bound is ``2 * SAMPLE`` texts of ``SAMPLE_CHARS``
    characters. An id labelled twice counts as toxic if one label says so; null labels and ids
    are left out, and so are null texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    # twice as many are looked up, since some are too long or have no text
    chosen = [known.where(F.col("_toxic") == c).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(2 * SAMPLE) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])  # bounded, hence the broadcast
    texts = docs.select(id_col, F.col(text_col).alias("_text")).where(F.char_length("_text") <= SAMPLE_CHARS)
    found = texts.join(F.broadcast(chosen), id_col).select(F.xxhash64(F.col(id_col)).alias("_order"), "_text", F.col("_toxic").cast("int").alias("_toxic"))
    rows = []
    for c in (0, 1):
        rows += [(r["_text"], bool(c)) for r in found.where(F.col("_toxic") == c).orderBy("_order", "_text").limit(SAMPLE).collect()]
    return fit(rows)


def toxic_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, ``score`` and ``spans``: ``start, end`` in characters and ``odds``.

    A null or empty text has no tokens and scores as a document without any sign does. Rows are
    scored one by one, so nulls, ties and repeated rows elsewhere change nothing; a table without
    rows gives none. Columns named ``score`` and ``spans`` are replaced.
    """
    short_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in ("score", "spans")])
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("odds", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered("words of the model", dict)
        if known.get(None) != model.name:  # what a worker remembers is of one model
            known.clear()
            known[None] = model.name
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                some = batch.slice(at, TEXTS)
                texts = [t or "" for t in some.column(text_col).to_pylist()]
                if len(known) > REMEMBERED:
                    known.clear()
                    known[None] = model.name
                split = [lines_of(t) for t in texts]
                counts = np.array([sum(map(len, lines)) for lines in split], np.int64)
                odds, _ = model.log_odds([words for lines in split for words in lines], known)
                owner = np.repeat(np.arange(len(texts)), counts)
                scores = model.scores(summary(odds, owner, len(texts)))
                first, likely = np.cumsum(counts) - counts, odds > np.log(LIKELY / (1 - LIKELY))
                spans = [_spans(t, odds[a : a + n], likely[a : a + n]) for t, a, n in zip(texts, first, counts)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(scores), pa.array(spans, kinds)], [*some.schema.names, "score", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("odds", T.DoubleType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("spans", span)])
    return docs.mapInArrow(run, schema)


def _spans(text: str, odds: np.ndarray, likely: np.ndarray) -> list[dict]:
    """Runs of likely tokens as offsets in the text."""
    if not likely.any():
        return []
    places, found, last = [m.span() for m in TOKEN.finditer(text)], [], -2
    for k in np.flatnonzero(likely).tolist():
        start, end = places[k]
        if k == last + 1:
            found[-1]["end"], found[-1]["odds"] = end, max(found[-1]["odds"], float(odds[k]))
        else:
            found.append({"start": start, "end": end, "odds": float(odds[k])})
        last = k
    return found
