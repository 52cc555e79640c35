"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary. A word's likelihood is the sum over all ways to cut it
into pieces, which a forward pass computes; a text's is the product over its words. The forward pass runs over all words of one
length at once, and only once for each different word of a task.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sent, col, fold, fold_col, has_letter, table, with_text

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
#: Labelled documents of each language that the probabilities are fitted on (about: they are picked by hash), and smoothing.
SAMPLE_DOCS, SMOOTHING = 4000, 0.1
#: Words whose likelihoods a task keeps.
KEPT_WORDS = 400_000
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
UNKNOWN = "und"
ROLL = np.uint64(0x9E3779B97F4A7C15)


def processor(tokenizers: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{tokenizers.rstrip('/')}/{VOCABULARY}")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall((text or "").lower())


def rolled(codes: np.ndarray) -> np.ndarray:
    """Hash of the code points along the last axis."""
    h = np.full(codes.shape[:-1], np.uint64(codes.shape[-1]), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[-1]):
            h = (h ^ codes[..., k].astype(np.uint64)) * ROLL
            h ^= h >> np.uint64(29)
    return h


class Model:
    """Piece probabilities by language. languages is sorted; table has a last row of zeros for what is no piece."""

    def __init__(self, languages: list[str], counts: dict[tuple[str, int], int], tokenizers: str = TOKENIZERS, smoothing: float = SMOOTHING):
        sp = processor(tokenizers)
        size = sp.get_piece_size()
        self.languages = languages
        p = np.full((size, len(languages)), smoothing)
        for (lang, piece), n in counts.items():
            p[piece, languages.index(lang)] += n
        p /= p.sum(0, keepdims=True) if len(languages) else 1.0
        self.table = np.vstack([p, np.zeros((1, len(languages)))])
        by_length: dict[int, list[tuple[str, int]]] = {}
        byte_of = {}
        for i in range(size):
            if sp.is_byte(i):
                byte_of[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                s = sp.id_to_piece(i)
                by_length.setdefault(len(s), []).append((s, i))
        self.bytes = p[[byte_of[b] for b in range(256)]]
        self.pieces = {}
        for n, held in by_length.items():
            h = rolled(np.array([[ord(c) for c in s] for s, _ in held], np.uint32))
            order = np.argsort(h)
            self.pieces[n] = (h[order], np.array([i for _, i in held])[order])

    def arcs(self, codes: np.ndarray, at: int, n: int) -> np.ndarray:
        """Probabilities (words, languages) of the pieces that codes have at a place; a character that is no piece counts as its bytes."""
        if n not in self.pieces:
            return None
        keys, ids = self.pieces[n]
        h = rolled(codes[:, at : at + n])
        k = np.searchsorted(keys, h)
        k[k == len(keys)] = 0
        found = np.where(keys[k] == h, ids[k], len(self.table) - 1)
        p = self.table[found]
        if n == 1:
            for j in np.flatnonzero(found == len(self.table) - 1):
                p[j] = np.prod(self.bytes[list(chr(codes[j, at]).encode("utf-8", "replace"))], axis=0)
        return p

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word by language, summed over all segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        longest = max(self.pieces)
        for n, group in by_length.items():
            step = max(1, 2_000_000 // (n * max(1, len(self.languages))))
            for a in range(0, len(group), step):
                part = group[a : a + step]
                codes = np.frombuffer("".join(MARK + words[k] for k in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                alpha = [np.ones((len(part), len(self.languages)))]  # of the last places, newest last, on a common scale
                scale = np.zeros_like(alpha[0])
                for end in range(1, n + 1):
                    total = np.zeros_like(scale)
                    for m in range(1, min(end, longest, len(alpha)) + 1):
                        p = self.arcs(codes, end - m, m)
                        if p is not None:
                            total += alpha[-m] * p
                    alpha.append(total)
                    alpha = alpha[-longest:]
                    if end % 8 == 0:
                        c = np.maximum(total, 1e-300)
                        scale += np.log(c)
                        alpha = [x / c for x in alpha]
                out[part] = scale + np.log(np.maximum(alpha[-1], 1e-300))
        return out


def fit(docs: DataFrame, *, text_col="text", lang_col="lang", tokenizers: str = TOKENIZERS, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Probabilities from about sample_docs labelled rows of each language, picked by a hash of the text; whole texts are used.

    Rows with null text or language are not used. Without labelled rows the model has no language. Every language that occurs is
    learned; the model has one number for each of them and each piece of the vocabulary.
    """
    rows = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], {}, tokenizers)
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, sample_docs / n)))])
    picked = rows.filter(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1_000_000)) < F.try_element_at(share, F.col("lang")) * 1_000_000)

    def count(batches):
        sp, counts = processor(tokenizers), Counter()
        for b in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, held in words.items():
                for ids, n in zip(sp.encode(list(held), num_threads=1), held.values()):
                    for i in ids:
                        counts[lang, i] += n
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["lang", "piece", "n"])

    counts = picked.mapInArrow(count, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
    got = {(r.lang, r.piece): r.n for r in counts.collect()}  # languages times pieces of the vocabulary at most
    return Model(sorted(sizes), got, tokenizers)


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def predict(docs: DataFrame, model: Model, *, text_col="text", keep: list[str] | None = None) -> DataFrame:
    """row (the columns in keep, all by default), lang_pred and score (the language's share of the likelihood, 0 to 1).

    Null texts and texts without letters are "und" with score 0, and so is everything if the model has no language. Ties go to the
    first language in sort order. Every row is predicted by its text alone, however long that is.
    """
    sent = Sent(docs.sparkSession, model)
    state: dict = {}

    def work(texts):
        m = sent.value
        rows: dict[str, int] = state.setdefault("rows", {})
        held: np.ndarray = state.get("scores", np.zeros((0, len(m.languages))))
        langs, scores = [], []
        for a in range(0, len(texts), 1000):
            each = [words_of(t) if has_letter(t) and m.languages else [] for t in texts[a : a + 1000]]
            if len(rows) > KEPT_WORDS:
                rows.clear()
                held = held[:0]
            new = [w for w in dict.fromkeys(w for ws in each for w in ws) if w not in rows]
            for w in new:
                rows[w] = len(rows)
            held = np.vstack([held, m.log_likelihoods(new)]) if new else held
            for ws in each:
                if not ws:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = held[np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws))].sum(0)
                best = int(total.argmax())
                langs.append(m.languages[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
        state["scores"] = held
        return {"lang_pred": langs, "score": scores}

    return with_text(docs, text_col, work, FIELDS, keep=keep)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; nulls, texts without letters and ties as predict has them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(fold_col(F.col("doc_id"), 3) != 1))
    found = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("row.doc_id", (fold_col(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLES: dict[str, str] = {}
__all__ = ["Model", "fit", "fold", "predict"]
