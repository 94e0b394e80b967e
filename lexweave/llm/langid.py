"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's letters, lower-cased, with other characters as word ends, are counted
as hashed n-grams of 1 to 3 characters.  Vectors are log-TF-IDF weighted and
of unit length; each language has several centroids, found by spherical
k-means.  The language of the nearest centroid by cosine wins; a text whose
best cosine is below the language's distance limit is rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.runtime import arrow_map, stored_map, text_of
from lexweave.llm.sampling import class_sample, placed

BUCKETS = 1 << 13
#: Labelled texts that are drawn of each language, at most.
PER_LANGUAGE = 1000
CENTROIDS = 4
UNKNOWN = "und"
#: Texts with fewer letters are never rejected for their distance.
FEW_LETTERS = 40

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str) -> tuple[np.ndarray, int]:
    """(counts per bucket, number of letters)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[points]
    total = int(letter.sum())
    if not total:
        return np.zeros(BUCKETS, np.float32), 0
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    points = np.concatenate(([32], points[keep], [32])).astype(np.uint32)
    one = points * np.uint32(2654435761)
    two = (one[:-1] ^ (points[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
    three = (two[:-1] ^ (points[2:] * np.uint32(668265263))) * np.uint32(374761393)
    shift = np.uint32(32 - 13)
    return np.bincount(np.concatenate((one >> shift, two >> shift, three >> shift)), minlength=BUCKETS).astype(np.float32), total


def _unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norms, 1e-12)


def _clustered(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out seeds (farthest first)."""
    seeds = [_unit(vectors.mean(axis=0, keepdims=True))[0]]
    while len(seeds) < min(k, len(vectors)):
        seeds.append(vectors[int((vectors @ np.array(seeds).T).max(axis=1).argmin())])
    centres = np.array(seeds)
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(axis=1)
        centres = _unit(np.array([vectors[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(len(centres))]))
    return centres


@dataclass
class CentroidModel:
    """Centroids (rows), their languages, IDF weights and distance limits."""

    languages: list[str]
    centres: np.ndarray
    owner: np.ndarray
    idf: np.ndarray
    limits: np.ndarray

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], k: int = CENTROIDS) -> CentroidModel:
        # One matrix, filled and weighted in place: it is what the fit holds.
        vectors, kept = np.zeros((len(texts), BUCKETS), np.float32), []
        for text, label in zip(texts, labels, strict=True):
            counts, letters = ngram_counts(text)
            if letters:
                vectors[len(kept)] = counts
                kept.append(label)
        languages, vectors = sorted(set(kept)), vectors[: len(kept)]
        if not kept:
            return cls([], np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.ones(BUCKETS, np.float32), np.zeros(0))
        idf = np.log((1 + len(kept)) / (1 + np.count_nonzero(vectors, axis=0))).astype(np.float32) + np.float32(0.1)
        np.log1p(vectors, out=vectors)
        vectors *= idf
        for row in vectors:
            row /= max(float(np.linalg.norm(row)), 1e-12)
        own = np.array([languages.index(label) for label in kept])
        centres, owner, limits = [], [], []
        for j in range(len(languages)):
            mine = vectors[own == j]
            found = _clustered(mine, k)
            centres.append(found)
            owner += [j] * len(found)
            # Half of what all but the farthest thousandth of the sample reaches.
            limits.append(0.5 * float(np.quantile((mine @ found.T).max(axis=1), 0.001)))
        return cls(languages, np.concatenate(centres).astype(np.float32), np.array(owner), idf, np.array(limits))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, rejected) of each text."""
        if not texts:
            return [], np.zeros(0), np.zeros(0, bool)
        counted = [ngram_counts(text) for text in texts]
        letters = np.array([n for _, n in counted])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        vectors = _unit(np.log1p(np.array([x for x, _ in counted])) * self.idf)
        cosines = vectors @ self.centres.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(texts)), best], 0.0, 1.0).astype(float)
        language = self.owner[best]
        rejected = (letters == 0) | ((score < self.limits[language]) & (letters >= FEW_LETTERS))
        score[letters == 0] = 0.0
        return [self.languages[j] if n else UNKNOWN for j, n in zip(language, letters, strict=True)], score, rejected


def fit_centroids(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, id_col: str = "doc_id") -> CentroidModel:
    """Fits on at most ``per_language`` texts of each non-null language, drawn
    by the hash of id and text (of the text alone without such a column)."""
    ident = F.col(id_col) if id_col in labelled.columns else F.lit(None).cast("long")
    rows = labelled.select(ident.alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = placed(rows, "id")
    sample, _ = class_sample(rows, rows, "lang", "text", per_language)
    return CentroidModel.fit([text for _, text, _ in sample], [lang for lang, _, _ in sample], centroids)


def identify(docs: DataFrame, model: CentroidModel, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred string, lang_score double, lang_rejected boolean``.

    * null texts and texts without a letter are ``und`` with score 0, rejected;
    * texts of under 40 letters are never rejected for their distance;
    * long texts are counted whole; ties go to the language first by name;
    * repeated rows are kept; columns of these three names are replaced; an
      empty table, or a model fitted on no rows, is no error.
    """
    return arrow_map(*_identified(docs, model, text_col))


def identified(docs: DataFrame, model: CentroidModel, text_col: str = "text", names: list[str] | None = None) -> DataFrame:
    """:func:`identify`, written to the shared folder by the same workers;
    ``names`` are the columns of ``docs`` that are kept, else all."""
    return stored_map(*_identified(docs, model, text_col, names), "languages").frame


def _identified(docs: DataFrame, model: CentroidModel, text_col: str, names: list[str] | None = None) -> tuple:
    """Frame, function and schema of :func:`identify`."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # centroids x buckets, whatever the corpus
    added = ("lang_pred", "lang_score", "lang_rejected")
    rows = docs.withColumn("lexweave_text", text_of(text_col))
    kept = docs.select(names if names is not None else docs.columns).drop(*added)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts, out = batch.column(batch.num_columns - 1), ([], [], [])
            for k in range(0, len(texts), 128):
                found = model.predict(texts.slice(k, 128).to_pylist())
                for column, values in zip(out, found, strict=True):
                    column.extend(values)
            columns = [*batch.columns[:-1], pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.bool_())]
            yield pa.record_batch(columns, names=[*batch.schema.names[:-1], *added])

    schema = kept.schema
    for name, kind in zip(added, ("string", "double", "boolean"), strict=True):
        schema = schema.add(name, kind)
    return rows.select(*schema.names[: -len(added)], "lexweave_text"), run, schema
