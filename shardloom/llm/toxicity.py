"""Toxic spans and document scores from a linear-chain conditional random field.

Labels exist per document only, so tokens are labelled from them first: a word is toxic when, over
the labelled sample, nearly all groups of alike documents that hold it are toxic. The field has two
states; a token's features are its word, prefixes and suffix (hashed bytes), and each line of a
text is one chain. Forward-backward gives each token's marginal probability; the largest marginal
and the expected number of toxic tokens give a document's score through a logistic calibration, and
runs of tokens above one half are the offending offsets.

The fit sees a bounded sample (``max_fit_docs`` documents per class, ``max_fit_chars`` characters
each, whole texts only). Scoring sees every whole text.
"""

from __future__ import annotations

import pickle
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.common import slices
from shardloom.session import ship_package

BITS = 18
PUNCTUATION = ".,;:!?\"'()[]{}<>*_-"
MAX_FIT_DOCS = 2000
MAX_FIT_CHARS = 10_000
ROUNDS = 40
CACHED_WORDS = 200_000
CHARS_AT_ONCE = 4_000_000
TOKENS_AT_ONCE = 1 << 18
TOKEN = re.compile(r"\S+")
RESULT = "score double, predicted int, spans array<struct<start:int,end:int,p:double>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
SCORED = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("spans", SPANS)])


def lines_of(text: str) -> list[list[str]]:
    """The chains of a text: the words of each line that has any, in lower case."""
    return [words for words in map(str.split, text.lower().split("\n")) if words]


def coded(texts: Iterable[str | None], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts as numbers from the vocabulary, which grows; words per chain, and per text.

    A word's string is kept once, whatever its text repeats, so memory follows the distinct words.
    """
    flat, lengths, per_text = array("i"), array("q"), array("q")
    for text in texts:
        before = len(flat)
        for line in lines_of(text or ""):
            flat.extend([vocabulary.setdefault(w, len(vocabulary)) for w in line])
            lengths.append(len(line))
        per_text.append(len(flat) - before)
    return np.array(flat, np.int32), np.array(lengths, np.int64), np.array(per_text, np.int64)


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word: the bias, the whole word, its last bytes and four prefixes. The
    checksum's start value tells the kinds apart."""
    core = (word.strip(PUNCTUATION) or word).encode("utf-8", "surrogatepass")
    crc, mask = zlib.crc32, (1 << BITS) - 1
    return (
        0,
        crc(core, 1) & mask,
        crc(core[-4:], 2) & mask,
        crc(core[:3], 3) & mask,
        crc(core[:4], 4) & mask,
        crc(core[:5], 5) & mask,
        crc(core[:6], 6) & mask,
    )


def feature_table(words: list[str]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(features, words)), np.int32, 7 * len(words)).reshape(-1, 7)


class Chains:
    """Chains of unequal length laid out step by step, longest first, so that one numpy operation
    moves all chains that are still running."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        sorted_lengths = lengths[order]
        steps = int(sorted_lengths[0]) if len(lengths) else 0
        running = np.searchsorted(-sorted_lengths, -np.arange(steps), side="left")
        self.bounds = np.concatenate([[0], np.cumsum(running)]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        step_of = np.repeat(np.arange(steps), running)
        chain_of = np.arange(int(self.bounds[-1])) - self.bounds[:-1][step_of]
        self.place = (first[chain_of] + step_of).astype(np.int32)  # where each laid-out token stands in the text order
        self.steps = steps

    def marginals(self, emission: np.ndarray, moves: np.ndarray, pairs: bool = False):
        """Probability of state 1 per token; with ``pairs`` also the expected transition counts.

        ``emission`` is the log odds of state 1 from the features, ``moves`` the 2x2 transition
        scores. Everything is kept as log odds between the states: a step of the recursion maps the
        odds of one token to those of the next.
        """
        e = emission[self.place]
        stay0, up, down, stay1 = moves[0, 0], moves[0, 1], moves[1, 0], moves[1, 1]
        ahead, back = np.zeros_like(e), np.zeros_like(e)
        b = self.bounds
        for t in range(self.steps):
            now = slice(b[t], b[t + 1])
            if t:
                prev = ahead[b[t - 1] : b[t - 1] + (b[t + 1] - b[t])]
                ahead[now] = e[now] + np.logaddexp(up, stay1 + prev) - np.logaddexp(stay0, down + prev)
            else:
                ahead[now] = e[now]
        for t in range(self.steps - 2, -1, -1):
            n = b[t + 2] - b[t + 1]
            after = back[b[t + 1] : b[t + 2]] + e[b[t + 1] : b[t + 2]]
            back[b[t] : b[t] + n] = np.logaddexp(down, stay1 + after) - np.logaddexp(stay0, up + after)
        p = np.empty_like(e)
        p[self.place] = ahead + back  # the log odds; what follows is 1 / (1 + exp(-p)), in place
        np.negative(np.clip(p, -30, 30, out=p), out=p)
        np.divide(1, np.add(np.exp(p, out=p), 1, out=p), out=p)
        if not pairs:
            return p
        counts = np.zeros((2, 2))
        for t in range(1, self.steps):
            n = b[t + 1] - b[t]
            prev = ahead[b[t - 1] : b[t - 1] + n]
            after = back[b[t] : b[t + 1]] + e[b[t] : b[t + 1]]
            joint = np.stack([np.full(n, stay0), up + after, down + prev, stay1 + prev + after])
            joint = np.exp(joint - joint.max(axis=0))
            counts += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return p, counts


def label_words(docs: list[set[str]], toxic: np.ndarray, clean_weight: float) -> set[str]:
    """Words to label as toxic, of documents as sets of words."""
    vocabulary: dict[str, int] = {}
    held = np.array([vocabulary.setdefault(w, len(vocabulary)) for words in docs for w in words], dtype=np.int64)
    doc_of = np.repeat(np.arange(len(docs)), [len(words) for words in docs])
    words = list(vocabulary)
    return {words[i] for i in np.flatnonzero(toxic_words(words, held, doc_of, toxic, clean_weight))}


def toxic_words(words: list[str], held: np.ndarray, doc_of: np.ndarray, toxic: np.ndarray, clean_weight: float) -> np.ndarray:
    """Which words to label as toxic: those held by at least four groups of toxic documents and, per
    group, at least nine times as often by toxic ones. Near copies share their smallest word hash nearly
    always and so count as one group; a passage they share is then no evidence.

    Document ``doc_of[i]`` holds the word numbered ``held[i]``, each pair once.
    """
    checksum = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64)
    smallest = np.full(len(toxic), 1 << 32, np.int64)
    np.minimum.at(smallest, doc_of, checksum[held])
    smallest[smallest == 1 << 32] = 0
    found, group = np.unique(smallest, return_inverse=True)
    of_toxic = toxic[doc_of]
    inside = np.unique(held[of_toxic] * len(found) + group[doc_of[of_toxic]]) // max(1, len(found))
    inside = np.bincount(inside, minlength=len(words))
    clean = np.flatnonzero(~toxic)
    speaks = np.zeros(len(toxic), dtype=bool)
    speaks[clean[np.unique(group[clean], return_index=True)[1]]] = True  # the first clean one of a group
    outside = np.bincount(held[speaks[doc_of]], minlength=len(words))
    return (inside >= 4) & (inside >= 9 * clean_weight * outside)


def aggregate(p: np.ndarray, doc_of: np.ndarray, n_docs: int) -> np.ndarray:
    """Two numbers per document from its tokens' marginals: log odds of the largest one, and the log
    of the expected number of toxic tokens among those above one in a hundred."""
    top = np.full(n_docs, 1e-6)
    np.maximum.at(top, doc_of, p)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    expected = np.bincount(doc_of, weights=np.where(p > 0.01, p, 0.0), minlength=n_docs)
    return np.stack([np.log(top / (1 - top)), np.log1p(expected)], axis=1)


def fit_field(texts: list[str], toxic: np.ndarray, clean_weight: float) -> dict:
    """Weights, transitions and calibration from labelled texts. With no toxic or no clean text the
    field stays at its starting point and every score is the share of toxic texts."""
    vocabulary: dict[str, int] = {}
    flat, lengths, per_doc = coded(texts, vocabulary)
    doc_of = np.repeat(np.arange(len(texts), dtype=np.int32), per_doc)
    bare: dict[str, int] = {}
    bare_of = np.array([bare.setdefault(w.strip(PUNCTUATION) or w, len(bare)) for w in vocabulary], dtype=np.int64)
    held = [np.unique(bare_of[flat[end - n : end]]) for n, end in zip(per_doc, np.cumsum(per_doc))]
    holder = np.repeat(np.arange(len(texts)), [len(words) for words in held])
    known = toxic_words(list(bare), np.concatenate([np.zeros(0, np.int64), *held]), holder, toxic, clean_weight)
    del held, holder
    weights, moves = np.zeros(1 << BITS), np.zeros((2, 2))
    weights[0] = -4.0
    share = float(toxic.mean()) if len(toxic) else 0.0
    blank = {"weights": weights.astype(np.float32), "moves": moves, "calibration": (0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))}
    if not known.any() or not toxic.any() or toxic.all():
        return blank

    # The longest chains first, a bounded number of tokens at a time.
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    stops = np.cumsum(lengths)
    moved = np.arange(len(flat)) + np.repeat(begins - (stops - lengths), lengths)
    flat, doc_of = flat[moved], doc_of[moved]
    del moved
    y = toxic[doc_of] & known[bare_of[flat]]
    found = feature_table(list(vocabulary))
    parts = [(Chains(lengths[a:b]), slice(stops[a] - lengths[a], stops[b - 1])) for a, b in slices(lengths, TOKENS_AT_ONCE)]
    first = np.zeros(len(flat), dtype=bool)
    first[stops - lengths] = True
    state = y.astype(np.int8)
    seen_pairs = np.bincount((state[:-1] * 2 + state[1:])[~first[1:]], minlength=4).reshape(2, 2)

    n = max(1.0, y.sum())
    parameters = np.concatenate([weights, moves.ravel()])
    mean, spread = np.zeros_like(parameters), np.zeros_like(parameters)
    for step in range(1, ROUNDS + 1):
        weights, moves = parameters[:-4], parameters[-4:].reshape(2, 2)
        scores, per_word, expected = weights[found].sum(axis=1), np.zeros(len(found)), np.zeros((2, 2))
        for layout, part in parts:
            p, pairs = layout.marginals(scores[flat[part]], moves, pairs=True)
            per_word += np.bincount(flat[part], weights=p - y[part], minlength=len(found))
            expected += pairs
        slope = np.bincount(found.ravel(), weights=np.repeat(per_word, 7), minlength=1 << BITS)
        slope = np.concatenate([slope, (expected - seen_pairs).ravel()]) / n + 1e-5 * parameters
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        parameters = parameters - 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-7)
    weights, moves = parameters[:-4], parameters[-4:].reshape(2, 2)
    scores = weights[found].sum(axis=1)
    p = np.concatenate([layout.marginals(scores[flat[part]], moves) for layout, part in parts])
    x = aggregate(p, doc_of, len(texts))
    return {"weights": weights.astype(np.float32), "moves": moves, "calibration": calibrate(x, toxic, clean_weight)}


def calibrate(x: np.ndarray, toxic: np.ndarray, clean_weight: float) -> tuple[float, float, float]:
    """Logistic regression on the two document numbers; clean rows weigh as many as they stand for."""
    design = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    row_weight = np.where(toxic, 1.0, clean_weight)
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (row_weight * (p - toxic)) + 0.1 * beta
        curve = (design * (row_weight * p * (1 - p) + 1e-9)[:, None]).T @ design + 0.1 * np.eye(3)
        change = np.linalg.solve(curve, slope)
        beta = beta - change * min(1.0, 5.0 / (np.abs(change).max() + 1e-9))
    return tuple(float(b) for b in beta)


def fit(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    usable: Column | None = None,
    max_fit_docs: int = MAX_FIT_DOCS,
    max_fit_chars: int = MAX_FIT_CHARS,
) -> bytes:
    """A fitted field as bytes, from up to ``max_fit_docs`` labelled documents of each class.

    ``labels`` has doc_id and toxic; ``usable`` is a condition on doc_id. Rows without a label, an
    id or a text don't take part; an id labelled twice counts as toxic if one label says so.
    Documents are taken in the order of a hash of their id, so the sample doesn't depend on files.
    """
    ship_package(spark)
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    if usable is not None:
        marked = marked.where(usable)
    marked = marked.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    lengths = docs.where(F.char_length("text") <= max_fit_chars).select("doc_id").distinct()
    marked = marked.join(lengths, "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    by_hash = lambda is_toxic: (
        marked.where(F.col("toxic") == is_toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_docs)
    )
    # 2 * max_fit_docs ids at most: the broadcast has a fixed bound.
    chosen = F.broadcast(by_hash(True).unionByName(by_hash(False)))
    sample = (
        docs.where(F.char_length("text") <= max_fit_chars)
        .select("doc_id", "text")
        .join(chosen, "doc_id")
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    )
    kept = min(sizes.get(False, 0), max_fit_docs)
    clean_weight = sizes.get(False, 0) / kept if kept else 1.0
    kept_toxic = min(sizes.get(True, 0), max_fit_docs)
    toxic_weight = sizes.get(True, 0) / kept_toxic if kept_toxic else 1.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "toxic": []}), *batches]).sort_values("doc_id")
        model = fit_field(list(rows["text"]), rows["toxic"].to_numpy(dtype=bool), clean_weight / toxic_weight)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    fitted = sample.coalesce(1).mapInPandas(run, "model binary").first()
    # Nothing labelled: Spark leaves the empty task out.
    return fitted["model"] if fitted else pickle.dumps(fit_field([], np.zeros(0, dtype=bool), 1.0))


def word_scores(model: dict, words: list[str], cache: dict[str, float]) -> None:
    """Put the emission scores of new words into the cache."""
    cache.update(zip(words, model["weights"][feature_table(words)].sum(axis=1, dtype=np.float64).tolist()))


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Character spans of the runs of tokens whose marginal is at least one half."""
    out, last = [], -2
    for i, found in enumerate(TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                out[-1]["end"], out[-1]["p"] = found.end(), max(out[-1]["p"], float(p[i]))
            else:
                out.append({"start": found.start(), "end": found.end(), "p": float(p[i])})
            last = i
    return out


def score_texts(model: dict, texts: list[str | None], cache: dict[str, float]) -> pd.DataFrame:
    vocabulary: dict[str, int] = {}
    flat, lengths, per_doc = coded(texts, vocabulary)
    words = list(vocabulary)
    new = [w for w in words if w not in cache]
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = words
    if new:
        word_scores(model, new, cache)
    emission = np.array([cache[w] for w in words])[flat] if words else np.zeros(0)
    p = Chains(lengths).marginals(emission, model["moves"])
    doc_of = np.repeat(np.arange(len(texts)), per_doc)
    a, b, c = model["calibration"]
    x = aggregate(p, doc_of, len(texts))
    score = 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))
    ends = np.cumsum(per_doc)
    offending = set(doc_of[p >= 0.5].tolist())
    spans = [spans_of(texts[d], p[ends[d] - per_doc[d] : ends[d]]) if d in offending else [] for d in range(len(texts))]
    return pd.DataFrame({"score": score, "predicted": (score >= 0.5).astype("int32"), "spans": spans})


def toxicity(spark: SparkSession, model: bytes, text: Column) -> Column:
    """Score, predicted class and offending spans of a text column as a struct.

    Null and empty texts have no tokens and get the calibration's floor. Texts of any length are
    scored whole. Rows are independent of each other, so ties and repeats get equal results.
    """
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # about 1 MB, whatever the corpus

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # The words are a task's own: a worker goes on to other work and must not hold them then.
        field, cache = pickle.loads(shared.value), {}
        for batch in batches:
            found = [pa.nulls(0, SCORED)]
            for a, b in slices(pc.fill_null(pc.binary_length(batch), 0).to_numpy(), CHARS_AT_ONCE):
                rows = score_texts(field, batch.slice(a, b - a).to_pylist(), cache)
                found.append(pa.StructArray.from_arrays([pa.array(rows[f.name], f.type) for f in SCORED], fields=list(SCORED)))
            yield pa.concat_arrays(found)

    return run(text)


def score_documents(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, score, predicted and spans of every document."""
    spark = docs.sparkSession
    scored = docs.select("doc_id", toxicity(spark, model, F.col("text")).alias("_t"))
    return scored.select("doc_id", "_t.*")
