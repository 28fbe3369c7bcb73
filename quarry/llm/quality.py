"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are characters (case kept, digits alike), its order is four. Counting,
smoothing and scoring are joins over n-gram tables:

1. every task reduces its texts to distinct 4-grams with their counts in trusted text (labelled
   good and not toxic); one aggregation by 4-gram gives the counts of the whole corpus;
2. lower orders count distinct left neighbours; the three discounts of each order come from
   the numbers of n-grams seen once to four times; probabilities of all 4-grams that occur
   anywhere are left joins of each order with its contexts, down to the single symbol;
3. texts are dealt into shards of bounded size, compressed together; the distinct 4-grams of each shard are joined with
   the probabilities, and shard and probabilities meet again to score each document.

A document's perplexity is exp(-mean log p) over its symbols and an end mark. It is kept if
that is at most the ``quantile`` of held-out perplexities of trusted documents in its language (of
all trusted documents, where its language is null or has none). Held out: trusted texts are dealt into
``FOLDS`` folds by their hash, so that copies share one, and each is scored by the model whose counts
are those of the other folds. Where one fold holds all trusted text, the whole model scores it.

Defined results: null or empty text has null perplexity and is rejected; without any trusted
text nothing can be judged: perplexities are those of a uniform model, thresholds are null and
texts that are not empty are kept. A document labelled more than once is trusted if no label speaks against it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import sliced, stored, table

ORDER = 4
QUANTILE = 0.99
#: Parts of trusted text; one model more is made for each.
FOLDS = 4
#: Characters of a shard, about.
SHARD_CHARS = 10_000_000
#: A task compresses its rows together, by shard, whenever it holds so many bytes of them.
PACKED_BYTES = 64 << 20
#: Distinct 4-grams (8 bytes each) that a task holds, of all its shards.
HELD_GRAMS = 8_000_000
#: 4-grams with their probabilities (50 bytes each) up to so many are broadcast; more are joined by a shuffle.
BROADCAST_GRAMS = 1_000_000
#: Trusted ids (8 bytes each) up to so many are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
_HEAD, _STOP = 2, 3  # symbols before and after a text


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-grams ending at each symbol of each text and at its end mark, 16 bits a symbol,
    and where each text's begin. Code points beyond 16 bits share the private-use area."""
    joined = "".join(f"\x02\x02\x02{t}\x03" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    sizes = np.array([len(t) for t in texts], np.int64) + ORDER
    ends = np.cumsum(sizes)
    points = np.where(points > 0xFFFF, 0xE000 + points % 0x1900, points)
    points = np.where((points >= 48) & (points <= 57), 48, points).astype(np.uint64)
    code = points[3:] | points[2:-1] << np.uint64(16) | points[1:-2] << np.uint64(32) | points[:-3] << np.uint64(48)
    wanted = np.ones(len(code), bool)
    for skip in range(ORDER - 1):  # grams that end in the next text's head
        wanted[(ends[:-1] - ORDER + 1 + skip)] = False
    starts = np.concatenate([[0], np.cumsum(sizes - ORDER + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    return code[wanted].view(np.int64), starts


def _fold(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(FOLDS))


def _grams(docs: DataFrame) -> DataFrame:
    """(code, n, f0, f1 ...): every 4-gram of the corpus with its count in trusted text and in each
    fold of it, from (text, fold), fold null where the text isn't trusted."""
    folds = [f"f{k}" for k in range(FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            parts: list[list[pd.Series]] = [[] for _ in range(FOLDS + 1)]
            for k in range(FOLDS + 1):
                some = [t for t, x in zip(texts, of) if x == (k if k < FOLDS else None)]
                for begin, stop in sliced(some):
                    where, codes = pd.factorize(gram_codes(some[begin:stop])[0])
                    parts[k].append(pd.Series(np.bincount(where, minlength=len(codes)), index=codes))
            totals = [pd.concat(p).groupby(level=0, sort=False).sum() if p else pd.Series([], index=np.zeros(0, np.int64), dtype=np.int64) for p in parts]
            codes = pd.unique(np.concatenate([t.index.to_numpy() for t in totals]))
            if len(codes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(codes, pa.int64()), *[pa.array(t.reindex(codes, fill_value=0).to_numpy().astype(np.int64)) for t in totals[:FOLDS]]], ["code", *folds])

    return (docs.mapInArrow(run, "code long, " + ", ".join(f"{f} long" for f in folds)).groupBy("code").agg(*[F.sum(f).alias(f) for f in folds])
            .select("code", reduce(Column.__add__, map(F.col, folds)).alias("n"), *folds))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, rows): the rows of each shard (all columns but the first), compressed together in
    parts, so that the shuffle of the texts moves fewer bytes."""
    parts: dict[int, list[pa.RecordBatch]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        packed = []
        for shard, of in parts.items():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, of[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(pa.Table.from_batches(of).combine_chunks())
            packed.append((shard, sink.getvalue().to_pybytes()))
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in packed], pa.int64()), pa.array([b for _, b in packed], pa.binary())], ["shard", "rows"])

    for batch in batches:
        shards = batch.column(0).to_numpy()
        rows = batch.select(batch.schema.names[1:]).take(pa.array(np.argsort(shards, kind="stable")))
        places, counts = np.unique(shards, return_counts=True)
        for shard, begin, n in zip(places.tolist(), np.cumsum(counts) - counts, counts):
            parts.setdefault(shard, []).append(rows.slice(begin, n))
        size += batch.nbytes
        if size >= PACKED_BYTES:
            yield out()
            parts.clear()
            size = 0
    if parts:
        yield out()


def _unpacked(rows: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(rows.as_buffer()).read_all()


def _bits(n: int) -> Column:
    return F.lit((1 << (16 * n)) - 1 if n < ORDER else -1)


def _suffix(code: Column, n: int) -> Column:
    return code if n == ORDER else code.bitwiseAND(_bits(n))


def probabilities(grams: DataFrame, models: list[str], wanted: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """(code, one log probability for each of ``models``) for every 4-gram of ``grams`` (code, and by each model's name
    its count in that model's text). All models go through one chain of joins; one without text has null, as have 4-grams for
    which the column of ``grams`` that ``wanted`` names for a model is 0."""
    seen = lambda m: F.col(m) > 0
    counts = {ORDER: grams.select("code", *models).where(reduce(Column.__or__, map(seen, models)))}
    for k in range(ORDER - 1, 0, -1):  # distinct left neighbours
        lower = counts[k + 1].groupBy(_suffix(F.col("code"), k).alias("code")).agg(*[F.count(F.when(seen(m), 1)).alias(m) for m in models])
        counts[k] = stored(lower, f"counts-{k}")
    of = lambda m: F.struct(*[F.count(F.when(F.col(m) == i, 1)).alias(f"n{i}") for i in range(1, 5)],
                            F.count(F.when(seen(m), 1)).alias("types"), F.coalesce(F.sum(m), F.lit(0)).alias("total")).alias(m)
    sums = {r["k"]: r for r in reduce(DataFrame.union, [c.agg(F.lit(k).alias("k"), *map(of, models)) for k, c in counts.items()]).collect()}  # a row for each order

    def discounts(r) -> list[float]:
        n = [0.0, *[float(max(r[f"n{i}"], 1)) for i in range(1, 5)]]
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), float(i) - 0.05) for i in (1, 2, 3)]

    n = lambda m: F.coalesce(m, F.lit(0))
    asked = grams.select("code")
    one = {m: sums[1][m] for m in models}
    table_ = (asked.select(_suffix(F.col("code"), 1).alias("code")).distinct().join(counts[1], "code", "left")
              .select("code", *[((n(m) + 0.5) / (one[m]["total"] + 0.5 * (one[m]["types"] + 1))).alias(f"p_{m}") for m in models]))
    for k in range(2, ORDER + 1):
        d = {m: discounts(sums[k][m]) for m in models}
        cut = lambda m: F.when(n(m) >= 3, d[m][2]).when(n(m) == 2, d[m][1]).when(n(m) == 1, d[m][0]).otherwise(0.0)  # noqa: B023, E731
        kinds = lambda m: (F.col(m) == 1, F.col(m) == 2, F.col(m) >= 3)
        contexts = counts[k].groupBy(F.shiftrightunsigned("code", 16).alias("context")).agg(
            *[F.sum(m).alias(f"all_{m}") for m in models],
            *[reduce(Column.__add__, [F.count(F.when(w, 1)) * d[m][i] for i, w in enumerate(kinds(m))]).alias(f"rest_{m}") for m in models])
        lower = table_.select(F.col("code").alias("lower"), *[F.col(f"p_{m}").alias(f"q_{m}") for m in models])
        follows = lambda m: F.coalesce(F.try_divide(n(m) - cut(m) + F.col(f"rest_{m}") * F.col(f"q_{m}"), F.col(f"all_{m}")), F.col(f"q_{m}"))
        codes = grams.select("code", *wanted.values()) if k == ORDER else asked.select(_suffix(F.col("code"), k).alias("code")).distinct()
        table_ = (codes.withColumn("lower", _suffix(F.col("code"), k - 1)).withColumn("context", F.shiftrightunsigned("code", 16))
                  .join(lower, "lower").join(counts[k], "code", "left").join(contexts, "context", "left")
                  .select("code", *(wanted.values() if k == ORDER else ()),
                          *[(F.when(F.col(wanted[m]) > 0, follows(m)) if k == ORDER and m in wanted else follows(m)).alias(f"p_{m}") for m in models]))
    return table_.select("code", *[(F.log(f"p_{m}") if one[m]["total"] or m == models[0] else F.lit(None).cast("double")).alias(m) for m in models])


def _all_probabilities(grams: DataFrame) -> DataFrame:
    """(code, logp, h0, h1 ...): h with a fold's number is the log probability by the other folds."""
    held = {f"h{k}": F.col("n") - F.col(f"f{k}") for k in range(FOLDS)}
    folds = {f"h{k}": f"f{k}" for k in range(FOLDS)}
    return probabilities(grams.select("code", F.col("n").alias("logp"), *folds.values(), *[c.alias(m) for m, c in held.items()]), ["logp", *held], folds)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that labels call good (quality 1) and none calls bad or toxic."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(good).alias("trusted")).where("trusted")


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, key, lang, trusted, perplexity, held_out) for every row; ``key`` is a hash of its text,
    ``held_out`` a trusted text's perplexity by the other folds (null where they hold no text)."""
    trusted = stored(trusted_ids(labels), "trusted")
    n = trusted.count()
    trusted = F.broadcast(trusted) if n <= BROADCAST_IDS else trusted
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    texts = rows.where("text <> ''").join(trusted, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    grams = stored(_grams(texts.select("text", F.when(F.col("trusted"), _fold(F.col("text"))).alias("fold"))), "grams")
    p = stored(_all_probabilities(grams), "probabilities")
    p = F.broadcast(p) if p.count() <= BROADCAST_GRAMS else p

    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-chars // (FOLDS * shard_chars)))  # of each fold, so that a shard needs one held-out model only
    rows_of = texts.select(
        (F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)) * FOLDS + _fold(F.col("text"))).alias("shard"), "doc_id", F.xxhash64("text").alias("key"), "lang", "text", "trusted")
    # both uses below read the same columns of this one shuffle of the texts, which Spark writes once
    dealt = rows_of.mapInArrow(_packed, "shard long, rows binary").repartition(shards * FOLDS, "shard")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        name = lambda: [pa.RecordBatch.from_arrays([pa.array(np.full(len(c), shard)), pa.array(c)], ["shard", "code"]) for shard, c in held.items()]
        for batch in batches:
            for shard, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                lines = _unpacked(packed).column("text").to_pylist()
                held[shard] = pd.unique(np.concatenate([held.get(shard, np.zeros(0, np.int64)), *[pd.unique(gram_codes(lines[a:b])[0]) for a, b in sliced(lines)]]))
                if sum(map(len, held.values())) > HELD_GRAMS:
                    yield from name()
                    held.clear()
        yield from name()

    # a shard with more 4-grams than HELD_GRAMS names some of them more than once
    known = dealt.mapInArrow(distinct, "shard long, code long").join(p, "code")
    held = F.coalesce(*[F.when(F.col("shard") % FOLDS == k, F.col(f"h{k}")) for k in range(FOLDS)])

    def judge(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        codes, logp, held = (theirs.column(c).to_numpy() for c in ("code", "logp", "held"))
        order = np.argsort(codes, kind="stable")
        codes, logp, held = codes[order], logp[order], held[order]
        told = []
        for packed in mine.column("rows"):  # unpacked one by one: the task holds the others compressed
            some = _unpacked(packed)
            lines, good = some.column("text").to_pylist(), some.column("trusted").to_numpy()
            out, apart = [], []
            for begin, stop in sliced(lines):
                grams_, starts = gram_codes(lines[begin:stop])
                where, distinct_ = pd.factorize(grams_)
                places, sizes = np.searchsorted(codes, distinct_), np.diff(np.append(starts, len(grams_)))
                for values, to in ((logp, out), (held, apart)):
                    if values is logp or good[begin:stop].any():
                        to.append(np.exp(-np.add.reduceat(values[places][where], starts) / sizes))
                    else:
                        to.append(np.full(stop - begin, np.nan))
            apart_ = np.concatenate(apart)
            told.append(pa.table([*[some.column(c) for c in ("doc_id", "key", "lang", "trusted")], pa.array(np.concatenate(out)),
                                  pa.array(apart_, mask=~good | np.isnan(apart_))], names=["doc_id", "key", "lang", "trusted", "perplexity", "held_out"]))
        return pa.concat_tables(told)

    judged = (dealt.groupBy("shard").cogroup(known.select("shard", "code", "logp", held.alias("held")).groupBy("shard"))
              .applyInArrow(judge, "doc_id long, key long, lang string, trusted boolean, perplexity double, held_out double"))
    none = F.lit(None).cast("double")
    blank = (rows.where("text is null or text = ''").join(trusted, "doc_id", "left")
             .select("doc_id", F.xxhash64("text").alias("key"), "lang", F.coalesce("trusted", F.lit(False)).alias("trusted"), none.alias("perplexity"), none.alias("held_out")))
    return judged.unionByName(blank)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, doc_id: str = "doc_id", text: str = "text",
             lang: str = "lang", shard_chars: int = SHARD_CHARS) -> DataFrame:
    """(doc_id, key, lang, perplexity, threshold, keep) for every row of ``docs``."""
    scores = stored(score(docs, labels, doc_id, text, lang, shard_chars), "perplexities")
    good = scores.where("trusted and perplexity is not null")
    high = F.percentile_approx(F.coalesce("held_out", "perplexity"), quantile, 10_000)
    by_lang = good.where("lang is not null").groupBy("lang").agg(high.alias("own"))  # a row for each language
    overall = good.agg(high.alias("v")).first()["v"]
    n = by_lang.count()
    by_lang = F.broadcast(by_lang) if n <= 10_000 else by_lang
    threshold = F.coalesce("own", F.lit(overall).cast("double"))
    return scores.join(by_lang, "lang", "left").select(
        "doc_id", "key", "lang", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.col("perplexity").isNotNull() & threshold.isNull()).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")
