"""Language identification in two steps: the language family, then the language within it.

A text becomes a vector of hashed byte trigrams (letters folded, everything else one
separator), over the whole text. Linear support vector machines, one for each
pair of classes, vote: first the machines between families, then those between the
languages of the chosen family. Each pair's machine is trained in a task of its own, on a
bounded sample of labelled texts (``PER_LANGUAGE`` different ones a language, at most; the text's hash draws them).
Tasks are sent the non-zero cells of the vectors and never hold a pair's vectors whole.

Defined results: null text or text without a letter: ``und`` with score 0, also where
nothing could be learned; a single learned language wins with score 1; ties in votes go to
the larger sum of margins, then to the first language code; repeated rows are judged each on their own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import sliced, table

#: Different labelled texts that training uses of each language, at most.
PER_LANGUAGE = 600
#: Parts of the labelled texts for scores of texts that training did not see.
FOLDS = 4
DIMENSIONS = 1 << 12
#: Share of rightly told rows of a language that its least score gives up.
LOW_QUANTILE = 0.01
UNDECIDED = "und"

# Families of ISO 639-1 codes; a code that is not listed is of family "other".
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ca co es fr gl ht it la oc pt ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu se",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "zh",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "rw sn sw xh zu",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
# bytes folded to lower-case ASCII letters and bytes of other letters; all else is the separator
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
# a vector's cell, counted down from the last, so that of two vectors the one whose next cell comes earlier sorts later
_CELL = np.dtype([("cell", ">u2"), ("value", "<f4")])


def family(lang: str) -> str:
    return FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], "other")


def features(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row of unit length for each text (zeros for one without trigrams)."""
    raws = [b" " + (t or "").encode() + b"  " for t in texts]
    octets = _FOLD[np.frombuffer(b"".join(raws), np.uint8)]
    owner = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    a, b, c = octets[:-2], octets[1:-1], octets[2:]
    code = (a.astype(np.uint32) << 16) | (b.astype(np.uint32) << 8) | c
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - int(dimensions).bit_length() + 1)
    inside = (b != 32) & (owner[:-2] == owner[2:])
    counts = np.bincount(owner[:-2][inside] * dimensions + cell[inside], minlength=len(raws) * dimensions)
    rows = counts.reshape(len(raws), dimensions).astype(np.float32)
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths == 0, 1, lengths)


def packed(row: np.ndarray) -> bytes:
    """The cells of a row that are not zero, with their values. The bytes sort as those of the whole row do."""
    cells = np.flatnonzero(row)
    out = np.empty(len(cells), _CELL)
    out["cell"], out["value"] = 0xFFFF - cells, row[cells]
    return out.tobytes()


class Rows:
    """Rows made of :func:`packed`, with a last cell of 1 for the bias. Only their non-zero cells are held; blocks
    of them and single rows are spread out when they are asked for."""

    def __init__(self, vectors: Iterable[bytes], dimensions: int = DIMENSIONS):
        vectors = list(vectors)
        cells = np.frombuffer(b"".join(vectors), _CELL)
        self.cells, self.values = (0xFFFF - cells["cell"]).astype(np.uint16), cells["value"].astype(np.float32)
        self.ends = np.cumsum([0, *[len(v) // _CELL.itemsize for v in vectors]])
        self.width = dimensions + 1

    def __len__(self) -> int:
        return len(self.ends) - 1

    def part(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ``i``'s cells and their values, without the bias."""
        return self.cells[self.ends[i]:self.ends[i + 1]], self.values[self.ends[i]:self.ends[i + 1]]

    def blocks(self, size: int = 64) -> Iterator[np.ndarray]:
        for begin in range(0, len(self), size):
            block = np.zeros((min(size, len(self) - begin), self.width))
            block[:, -1] = 1
            for k, row in enumerate(block):
                cells, values = self.part(begin + k)
                row[cells] = values
            yield block


def train_svm(x: Rows, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """Linear SVM (y is -1 or 1) by dual coordinate descent: weights with the bias last, and
    slope and shift of the sigmoid that turns margins into probabilities."""
    norms, alpha, w = np.concatenate([(b * b).sum(axis=1) for b in x.blocks()]), np.zeros(len(x)), np.zeros(x.width)
    limit = cost * len(y) / 2 / np.where(y > 0, (y > 0).sum(), (y < 0).sum())  # both classes weigh the same
    order = np.random.default_rng(seed)
    row = np.zeros(x.width)
    row[-1] = 1
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            cells, values = x.part(i)
            row[cells] = values
            new = min(max(alpha[i] - (y[i] * (row @ w) - 1) / norms[i], 0.0), limit[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * row
                alpha[i] = new
            row[cells] = 0
    margin = np.concatenate([b @ w for b in x.blocks()])
    above, below = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (above + 1) / (above + 2), 1 / (below + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps for the two parameters
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return w, float(max(slope, 1e-3)), float(shift)


def fit_pair(frame: pd.DataFrame) -> pd.DataFrame:
    """The machine of one pair of classes, from its rows (pair, side, vector). The sample is bounded for each language, a family
    has the rows of all of its languages: a task holds their non-zero cells and one block of whole rows."""
    frame = frame.sort_values(["side", "vector"])  # the same order in every run
    y = frame["side"].to_numpy()
    if len(set(y)) < 2:  # one side has no sampled row: the other always wins
        w, slope, shift = np.zeros(DIMENSIONS + 1), 1.0, 0.0
        w[-1] = y[0]
    else:
        w, slope, shift = train_svm(Rows(frame["vector"]), y)
    return pd.DataFrame({"pair": frame["pair"].iloc[:1], "weights": [w.tolist()], "slope": [slope], "shift": [shift]})


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> dict:
    """The machines, from rows with a non-null language: {level: {(a, b): (weights, slope, shift)}} and the languages."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    drawn = F.xxhash64("text", "lang")
    lowest = (rows.select("lang", drawn.alias("hash")).distinct()
              .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= per_language))
    highest = {r["lang"]: r["hash"] for r in lowest.groupBy("lang").agg(F.max("hash").alias("hash")).collect()}  # one row for each language
    languages = sorted(highest)
    pairs: dict[tuple[str, str, str], None] = {}
    families = defaultdict(list)
    for code in languages:
        families[family(code)].append(code)
    for a, b in combinations(sorted(families), 2):
        pairs["family", a, b] = None
    for codes in families.values():
        for a, b in combinations(codes, 2):
            pairs["lang", a, b] = None
    model = {"languages": languages, "families": {f: codes for f, codes in families.items()}, "pairs": {}}
    if not pairs:
        return model

    bound = F.element_at(F.create_map(*[F.lit(v) for pair in highest.items() for v in pair]), F.col("lang"))
    sample = rows.withColumn("hash", drawn).where(F.col("hash") <= bound).dropDuplicates(["lang", "hash"]).select("text", "lang")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, stop in sliced(texts):
                made = features(texts[begin:stop])
                out = []
                for code, row in zip(codes[begin:stop], map(packed, made)):
                    for k, (level, a, b) in enumerate(pairs):
                        mine = family(code) if level == "family" else code
                        if mine in (a, b):
                            out.append((k, 1 if mine == b else -1, row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))] if out else
                    [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["pair", "side", "vector"])

    fitted = sample.mapInArrow(vectors, "pair long, side long, vector binary").groupBy("pair").applyInPandas(
        fit_pair, "pair long, weights array<double>, slope double, shift double")
    for r in fitted.collect():  # a row of DIMENSIONS numbers for each pair of classes
        model["pairs"][list(pairs)[r["pair"]]] = (np.array(r["weights"]), r["slope"], r["shift"])
    return model


def _vote(x: np.ndarray, classes: list[str], level: str, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """The winner's number among ``classes`` and the mean of its pairwise probabilities, for each row."""
    if len(classes) == 1:
        return np.zeros(len(x), int), np.ones(len(x))
    votes, margins, chance = (np.zeros((len(x), len(classes))) for _ in range(3))
    for (i, a), (j, b) in combinations(enumerate(classes), 2):
        machine = model["pairs"].get((level, a, b))
        if machine is None:
            continue
        w, slope, shift = machine
        margin = x @ w[:-1] + w[-1]
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        votes[:, j] += margin > 0
        votes[:, i] += margin <= 0
        margins[:, j] += margin
        margins[:, i] -= margin
        chance[:, j] += p
        chance[:, i] += 1 - p
    best = (votes + 0.5 * np.tanh(margins / len(classes))).argmax(axis=1)
    return best, chance[np.arange(len(x)), best] / (len(classes) - 1)


def decide(texts: list[str | None], model: dict) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    names, scores = [UNDECIDED] * len(texts), np.zeros(len(texts))
    seen = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    if not seen or not model["languages"]:
        return names, scores.tolist()
    x = features([texts[i] for i in seen])
    groups = sorted(model["families"])
    chosen, sure = _vote(x, groups, "family", model)
    for k in set(chosen.tolist()):
        codes, rows = model["families"][groups[k]], np.flatnonzero(chosen == k)
        won, p = _vote(x[rows], codes, "lang", model)
        for row, code, score in zip(rows, won, p):
            names[seen[row]] = codes[code]
            scores[seen[row]] = sure[row] * score
    return names, scores.tolist()


def identify(docs: DataFrame, model: dict, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row; columns of these names are replaced. Other columns stay and no row moves."""
    kept = [c for c in docs.columns if c not in (lang_pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            names: list[str] = []
            scores: list[float] = []
            for begin, stop in sliced(texts):
                a, b = decide(texts[begin:stop], model)
                names += a
                scores += b
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, lang_pred, score])

    rows = docs.select(*kept, F.col(text).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*kept).schema)
    return rows.mapInArrow(run, f"{fields}`{lang_pred}` string, `{score}` double")


def least_scores(docs: DataFrame, trainable: Column, quantile: float = LOW_QUANTILE, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """For each language, the low ``quantile`` of the scores of all labelled rows that are told rightly by a model that did not
    see their text: labelled texts are dealt into ``FOLDS`` folds by their hash, and each fold is scored by a model of the
    ``trainable`` rows of the others. Texts of a language that was not learned, code and encoded data score lower. Languages without
    such rows are missing."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("long").alias("fold"),
                                                      trainable.alias("trainable"))
    models = [learn(rows.where(F.col("trainable") & (F.col("fold") != k))) for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, codes, folds = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple[str, float]] = []
            for begin, stop in sliced(texts):
                for k, model in enumerate(models):
                    mine = [i for i in range(begin, stop) if folds[i] == k]
                    told, scores = decide([texts[i] for i in mine], model)
                    out += [(codes[i], s) for i, t, s in zip(mine, told, scores) if t == codes[i]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["lang", "score"])

    told = rows.select("text", "lang", "fold").mapInArrow(run, "lang string, score double")
    low = told.groupBy("lang").agg(F.percentile_approx("score", quantile, 10_000).alias("low")).collect()  # a row for each language
    return {r["lang"]: r["low"] for r in low}


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", "score")
