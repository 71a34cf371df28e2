"""Vocabularies as tables (token, freq, id), encoding and decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from gridloom.functions.text import MAX_WORD_CHARS, UNKNOWN
from gridloom.operators.lookup import checked_lookup, fits_broadcast, row_limit
from gridloom.operators.ordering import ordered_prefix
from gridloom.operators.tensors import explode_rows, pack_cells
from gridloom.session import cut_lineage
from gridloom.sources.ranges import RANGED, open_path

WORD_CACHE = 50_000
#: Tokens of a slice of an Arrow batch that are looked up at once.
SLICE_TOKENS = 500_000
VECTOR_ROWS = 50_000
#: Vectors read at once, and (token, row) pairs whose vectors are held at once, where vectors are added up.
VECTOR_BLOCK, PAIRS_AT_ONCE = 16_384, 65_536


def token_counts(df: DataFrame, tokens: str) -> DataFrame:
    """Token frequencies; counts are combined before the shuffle, so frequent tokens cost nothing extra."""
    return explode_rows(df, tokens, [], value="token").groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def build_vocabulary(
    df: DataFrame,
    tokens: str,
    min_frequency: int = 10,
    reserved: list[str] | None = None,
    unknown: str = UNKNOWN,
    max_size: int | None = None,
) -> DataFrame:
    """(token, freq, id): reserved tokens, the unknown token, then tokens by frequency and spelling.

    ``max_size`` keeps the most frequent tokens so that the whole table has that many rows. The counts
    are written once, because ranking reads them more than once.
    """
    head = list(dict.fromkeys([*(reserved or []), unknown]))
    if max_size is not None and max_size < len(head):
        raise ValueError("the vocabulary cannot be smaller than its reserved tokens")
    counts = token_counts(df, tokens).filter((F.col("freq") >= min_frequency) & ~F.col("token").isin(head))
    ranked = ordered_prefix(cut_lineage(counts), "freq", "token", index="id", descending=True)
    ranked = ranked.withColumn("id", F.col("id") + len(head))
    if max_size is not None:
        ranked = ranked.filter(F.col("id") < max_size)
    spark = df.sparkSession
    first = spark.createDataFrame([(t, 0, i) for i, t in enumerate(head)], "token string, freq long, id long")
    return first.unionByName(ranked.select("token", "freq", "id"))


def encode(
    df: DataFrame,
    tokens: str,
    vocabulary: DataFrame,
    key: str,
    unknown: str = UNKNOWN,
    target: str = "ids",
    max_rows: int | None = None,
) -> DataFrame:
    """Add the ids of ``tokens``; a token without id, and a null one, gets the id of ``unknown``; a null list stays null.

    A vocabulary small in rows (``max_rows``) and bytes goes to every executor and whole Arrow batches are looked up
    without any shuffle. A larger one is joined token by token with salted keys. Both give the same rows; ``key`` must
    tell rows apart and may be null in one of them.
    """
    vocabulary = vocabulary.select("token", "id")
    if fits_broadcast(vocabulary, max_rows):
        table = vocabulary.select(F.col("token").cast("string"), F.col("id").cast("long")).toArrow().sort_by("id").combine_chunks()
        unknown_id = table.filter(pc.equal(table["token"], unknown))["id"][0].as_py()
        return df.withColumn(target, _id_lookup(_shared_table(df, table), unknown_id)(F.col(tokens)))
    unknown_id = vocabulary.filter(F.col("token") == unknown).first()["id"]
    exploded = explode_rows(df, tokens, [key], value="token")
    joined = checked_lookup(exploded, vocabulary.withColumnRenamed("id", "_id"), ["token"], [key, "pos"], max_rows=max_rows)
    packed = pack_cells(joined.withColumn("_id", F.coalesce("_id", F.lit(unknown_id))), [key], "pos", "_id", target)
    return _joined_back(df, packed, tokens, key, target, "array<long>")


def known_ids(df: DataFrame, tokens: str, vocabulary: DataFrame, target: str = "ids", max_rows: int | None = None) -> DataFrame:
    """One row of ids per row of ``df``, without the tokens that have no id, in order; nothing else is kept.

    A vocabulary small in rows (``max_rows``) and bytes goes to every executor; a larger one is joined token by token, where
    rows without any known token are left out.
    """
    vocabulary = vocabulary.select(F.col("token").cast("string").alias("token"), F.col("id").cast("long").alias("id"))
    if fits_broadcast(vocabulary, max_rows):
        table = vocabulary.toArrow().sort_by("id").combine_chunks()
        looked_up = _id_lookup(_shared_table(df, table), -1)(F.col(tokens))
        return df.select(F.filter(looked_up, lambda x: x >= 0).alias(target))
    numbered = cut_lineage(df.select(F.monotonically_increasing_id().alias("_row"), tokens))
    joined = checked_lookup(explode_rows(numbered, tokens, ["_row"], value="token"), vocabulary, ["token"], ["_row", "pos"], "inner", max_rows)
    return pack_cells(joined, ["_row"], "pos", "id", target).select(target)


def _joined_back(df: DataFrame, packed: DataFrame, tokens: str, key: str, target: str, kind: str) -> DataFrame:
    """``packed`` (key, target) back to the rows it came from: a null key meets itself, an empty list gives an empty one."""
    named = packed.select(F.col(key).alias("_key"), F.col(target).alias("_packed"))
    joined = df.join(named, F.col(key).eqNullSafe(F.col("_key")), "left")
    return joined.withColumn(target, F.when(F.col(tokens).isNotNull(), F.coalesce("_packed", F.array().cast(kind)))).drop("_key", "_packed")


def _shared_table(df: DataFrame, table: pa.Table):
    """``table`` for all tasks as one block of bytes, which a task reads in place: no objects per row."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return df.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())


def _opened(shared, state: dict) -> dict:
    """The columns of a shared table, opened once per task."""
    if not state:
        table = pa.ipc.open_stream(pa.py_buffer(shared.value)).read_all()
        state.update({name: _flat(table[name]) for name in table.column_names})
    return state


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays([pa.array([], column.type), *column.chunks])


def _places(flat: pa.Array, value_set: pa.Array, missing: int) -> np.ndarray:
    """The place of every element in ``value_set``, ``missing`` where it has none; elements are taken in slices."""
    out = np.empty(len(flat), np.int32)
    for start in range(0, len(flat), SLICE_TOKENS):
        # Each element of the slice is hashed once; the distinct ones are looked up.
        coded = flat.slice(start, SLICE_TOKENS).dictionary_encode()
        known = pc.index_in(coded.dictionary, value_set=value_set).fill_null(missing)
        out[start : start + SLICE_TOKENS] = known.take(coded.indices).fill_null(missing).to_numpy(zero_copy_only=False)
    return out


def _starts(column: pa.Array) -> pa.Array:
    """Offsets of a list column in its flattened elements."""
    offsets = pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0))
    return pa.concat_arrays([pa.array([0], pa.int32()), offsets.cast(pa.int32())])


def _id_lookup(shared, unknown_id: int):
    state: dict = {}

    @F.arrow_udf("array<bigint>")
    def lookup(column: pa.Array) -> pa.Array:
        table = _opened(shared, state)
        ids = np.append(table["id"].to_numpy(), unknown_id)
        found = ids[_places(column.flatten().cast(pa.string()), table["token"], len(ids) - 1)]
        return pa.ListArray.from_arrays(_starts(column), pa.array(found, pa.int64()), mask=column.is_null())

    return lookup


def _token_lookup(shared, unknown: str):
    state: dict = {}

    @F.arrow_udf("array<string>")
    def lookup(column: pa.Array) -> pa.Array:
        table = _opened(shared, state)
        words = pa.concat_arrays([table["token"], pa.array([unknown], pa.string())])
        ids = column.flatten().cast(pa.int64())
        # An id without a token is the unknown one; a null id has no place among the tokens.
        places = pa.array(_places(ids, table["id"], len(words) - 1), mask=ids.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(_starts(column), words.take(places), mask=column.is_null())

    return lookup


def decode(df: DataFrame, ids: str, vocabulary: DataFrame, key: str, stop: str | None = None,
           unknown: str = UNKNOWN, target: str = "tokens", max_rows: int | None = None) -> DataFrame:
    """Tokens of ``ids``; with ``stop`` the list ends before the first stop token.

    Every row stays: a null list stays null, an empty one stays empty, and the key may be null in one row.
    """
    vocabulary = vocabulary.select("id", "token")
    if not fits_broadcast(vocabulary, max_rows):
        return _decode_by_join(df, ids, vocabulary, key, stop, unknown, target, max_rows)
    # Rows of a repeated key are packed together; all others are decoded where they are.
    named = df.withColumn("_key", F.struct(F.col(key).alias("k")))
    repeated = cut_lineage(named.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1).select("_key"))
    table = vocabulary.select(F.col("token").cast("string"), F.col("id").cast("long")).toArrow().combine_chunks()
    words = F.filter(_token_lookup(_shared_table(df, table), unknown)(F.col(ids)), lambda x: x.isNotNull())
    if repeated.isEmpty():
        return _until(df.withColumn(target, words), target, stop)
    single = checked_lookup(named, repeated, ["_key"], [key], how="left_anti").drop("_key")
    several = checked_lookup(named, repeated, ["_key"], [key], how="left_semi").drop("_key")
    joined = _decode_by_join(several, ids, vocabulary, key, stop, unknown, target, max_rows)
    return _until(single.withColumn(target, words), target, stop).unionByName(joined)


def _until(df: DataFrame, target: str, stop: str | None) -> DataFrame:
    """``target`` cut before its first ``stop``."""
    if stop is None:
        return df
    place = F.array_position(target, stop)
    return df.withColumn(target, F.when(place > 0, F.slice(target, F.lit(1), (place - 1).cast("int"))).otherwise(F.col(target)))


def _decode_by_join(df: DataFrame, ids: str, vocabulary: DataFrame, key: str, stop: str | None, unknown: str, target: str,
                    max_rows: int | None) -> DataFrame:
    exploded = df.select(key, F.posexplode_outer(ids).alias("pos", "id"))
    joined = checked_lookup(exploded, vocabulary, ["id"], [key, "pos"], max_rows=max_rows)
    named = joined.withColumn("token", F.when(F.col("id").isNotNull(), F.coalesce("token", F.lit(unknown))))
    packed = pack_cells(named, [key], "pos", "token", target)
    packed = _until(packed.withColumn(target, F.filter(target, lambda x: x.isNotNull())), target, stop)
    return _joined_back(df, packed, ids, key, target, "array<string>")


def word_pieces(df: DataFrame, tokens: str, vocabulary: DataFrame, key: str, unknown: str = "[UNK]",
                target: str = "pieces", max_rows: int | None = None) -> DataFrame:
    """Greedy longest-prefix pieces with ``##`` continuations; a word that cannot be covered is unknown.

    An empty word has no pieces, a null word is unknown, a null list stays null, and a word's length counts UTF-16 units.
    A vocabulary small in rows (``max_rows``) and bytes is broadcast: each task remembers the pieces of words it has met,
    so repeated words cost a dictionary lookup and no shuffle is needed. A larger one is joined with the parts of the
    distinct words. Both give the same rows; ``key`` must tell rows apart and may be null in one of them.
    """
    if not fits_broadcast(vocabulary.select("token"), max_rows):
        return _pieces_by_join(df, tokens, vocabulary.select("token"), key, unknown, target)
    shared = _shared_table(df, vocabulary.select(F.col("token").cast("string")).toArrow().combine_chunks())
    state: dict = {}
    known: set[str] = set()
    cache: dict[str, list[str]] = {}

    def cover(word: str | None) -> list[str]:
        if word is None or len(word.encode("utf-16-le")) // 2 > MAX_WORD_CHARS:
            return [unknown]
        found, start = [], 0
        while start < len(word):
            lead = "##" if start else ""
            stop = next((e for e in range(len(word), start, -1) if lead + word[start:e] in known), None)
            if stop is None:
                return [unknown]
            found.append(lead + word[start:stop])
            start = stop
        return found

    def cached(word: str) -> list[str]:
        parts = cache.get(word)
        if parts is None:
            if len(cache) >= WORD_CACHE:
                cache.clear()
            parts = cache[word] = cover(word)
        return parts

    @F.arrow_udf(ArrayType(StringType()))
    def pieces(column: pa.Array) -> pa.Array:
        if not known:
            known.update(_opened(shared, state)["token"].to_pylist())
            state.clear()
        # Each distinct word of the batch is covered once; rows are put together by their offsets.
        coded = column.flatten().cast(pa.string()).dictionary_encode()
        lists = pa.array((cached(word) for word in [*coded.dictionary.to_pylist(), None]), pa.list_(pa.string()))
        expanded = lists.take(pc.fill_null(coded.indices, len(coded.dictionary)))
        starts = expanded.offsets.take(_starts(column)) if len(expanded) else _starts(column)
        return pa.ListArray.from_arrays(starts, expanded.values, mask=column.is_null())

    return df.withColumn(target, pieces(F.col(tokens)))


def _pieces_by_join(df: DataFrame, tokens: str, vocabulary: DataFrame, key: str, unknown: str, target: str) -> DataFrame:
    """Word pieces of distinct words through joins with the vocabulary, then back to the documents.

    A word has at most 200 characters, so its parts are bounded. The longest known part from each start is kept
    and the chain of parts is followed from the first character.
    """
    longest = vocabulary.agg(F.max(F.length("token"))).first()[0]
    exploded = explode_rows(df, tokens, [key], value="word")
    words = cut_lineage(exploded.select("word").distinct())
    size = F.length("word")
    units = F.octet_length(F.encode("word", "UTF-16LE")) / 2
    short = words.filter((size >= 1) & (units <= MAX_WORD_CHARS))
    parts = short.withColumn("start", F.explode(F.sequence(F.lit(1), size)))
    parts = parts.withColumn("stop", F.explode(F.sequence(F.col("start"), F.least(size, F.col("start") + longest - 1))))
    part = F.substring("word", F.col("start"), F.col("stop") - F.col("start") + 1)
    parts = parts.withColumn("token", F.when(F.col("start") > 1, F.concat(F.lit("##"), part)).otherwise(part))
    known = checked_lookup(parts, vocabulary.distinct(), ["token"], ["word", "start"], how="left_semi")
    steps = known.groupBy("word", "start").agg(F.max_by(F.struct("stop", "token"), "stop").alias("step"))
    steps = steps.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("start", "step"))).alias("_steps"))

    def follow(state, place):
        step = F.try_element_at("_steps", place)
        here = state["next"] == place
        moved = F.struct((step["stop"] + 1).alias("next"), F.concat(state["found"], F.array(step["token"])).alias("found"))
        return F.when(here & step.isNotNull(), moved).otherwise(state)

    begin = F.struct(F.lit(1).alias("next"), F.array().cast("array<string>").alias("found"))
    chain = F.aggregate(F.sequence(F.lit(1), size), begin, follow)
    covered = steps.withColumn("_chain", chain).withColumn(
        "_pieces", F.when(F.col("_chain.next") == size + 1, F.col("_chain.found"))
    )
    table = cut_lineage(covered.filter(F.col("_pieces").isNotNull()).select("word", "_pieces"))
    joined = checked_lookup(exploded, table, ["word"], [key, "pos"])
    nothing = F.when(F.col("word") == "", F.array().cast("array<string>"))
    joined = joined.withColumn("_pieces", F.coalesce("_pieces", nothing, F.array(F.lit(unknown))))
    packed = pack_cells(joined, [key], "pos", "_pieces", "_packed").select(key, F.flatten("_packed").alias(target))
    return _joined_back(df, packed, tokens, key, target, "array<string>")


def embed(df: DataFrame, tokens: str, vectors: DataFrame, key: str, unknown: str = UNKNOWN,
          max_rows: int | None = None, added: bool = False) -> DataFrame:
    """Vectors (token, vector) of every token in order: (key, pos, vector); unknown tokens share one vector.

    Many vectors are looked up in two ways: those of the most frequent tokens are broadcast, so that only the rows of rarer
    ones are shuffled to theirs. ``added`` gives one row per row of ``df`` instead, (key, sums, counts): its vectors added up
    entry by entry where its tokens are, without a row per token, and how many had a value there.
    """
    fallback = vectors.filter(F.col("token") == unknown).select("vector").first()["vector"]
    default = F.array(*[F.lit(float(x)) for x in fallback])
    if added:
        return _added_vectors(df, tokens, vectors.select("token", F.coalesce(F.col("vector").cast("array<double>"), default).alias("vector")), key, fallback)
    exploded = explode_rows(df, tokens, [key], value="token")
    limit = min(VECTOR_ROWS, row_limit(max_rows))
    if fits_broadcast(vectors, limit):
        joined = exploded.join(F.broadcast(vectors), ["token"], "left")
    else:
        frequent = token_counts(df, tokens).orderBy(F.col("freq").desc(), "token").limit(limit).select(F.col("token").alias("_token"))
        frequent = cut_lineage(frequent)
        near = cut_lineage(frequent.join(vectors, F.col("_token") == F.col("token"), "left").select("_token", "vector"))
        same = F.col("token").eqNullSafe(F.col("_token"))
        met = exploded.join(F.broadcast(near), same, "inner").select(key, "pos", "vector")
        rest = exploded.join(F.broadcast(frequent), same, "left_anti")
        joined = met.unionByName(rest.join(vectors, ["token"], "left").select(key, "pos", "vector"))
    return joined.select(key, "pos", F.coalesce("vector", default).alias("vector"))


def _added_vectors(df: DataFrame, tokens: str, vectors: DataFrame, key: str, fallback: list[float]) -> DataFrame:
    """(key, sums, counts) of every row: tasks go through the written vectors in blocks, once per Arrow batch of rows."""
    vectors = cut_lineage(vectors)
    files = vectors.inputFiles()
    if not all(path.split(":", 1)[0] in RANGED for path in files):
        cells = explode_rows(embed(df, tokens, vectors, key), "vector", [key], "dim", "x")
        return _packed_sums(cells, key)
    width = max(len(fallback), vectors.agg(F.max(F.size("vector"))).first()[0] or 0)
    kind = df.schema[key].dataType.simpleString()

    def blocks() -> Iterator[tuple[pa.Array, pa.Array]]:
        for path in files:
            system, place = open_path(path)
            with system.open_input_file(place) as source:
                for block in pq.ParquetFile(source).iter_batches(VECTOR_BLOCK, columns=["token", "vector"]):
                    yield block.column("token").cast(pa.string()), block.column("vector")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts, reach = _batch_sums(batch.column(1), blocks, fallback, width)
            inside = np.arange(width) < reach[:, None]
            starts = pa.array(np.append(0, np.cumsum(reach)), pa.int32())
            lists = [pa.ListArray.from_arrays(starts, pa.array(x[inside])) for x in (sums, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=[key, "sums", "counts"])

    return df.select(key, tokens).mapInArrow(add, f"`{key}` {kind}, sums array<double>, counts array<bigint>")


def _dense(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of numbers as a matrix with zeros for what is missing, what is there, and the lengths."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    inside = np.arange(width) < lengths[:, None]
    values, there = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    values[inside] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    there[inside] = flat.is_valid().to_numpy(zero_copy_only=False)
    return values, there, lengths


def _batch_sums(column: pa.Array, blocks: Callable, fallback: list[float], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and lengths of the added vectors of every list of tokens."""
    rows = len(column)
    sums, counts, reach = np.zeros((rows, width)), np.zeros((rows, width), np.int64), np.zeros(rows, np.int64)
    coded = column.flatten().cast(pa.string()).dictionary_encode()
    words = coded.dictionary
    codes = coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    # (word, row) and how often, in the order of the words.
    pairs = []
    for start in range(0, len(codes), SLICE_TOKENS):
        part = codes[start : start + SLICE_TOKENS].astype(np.int64)
        row = np.searchsorted(ends, np.arange(start, start + len(part)), "right")
        pairs.append(np.unique(part * rows + row, return_counts=True))
    if not pairs:
        return sums, counts, reach
    keys, times = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    row_of = (keys % rows).astype(np.int32)
    first = np.searchsorted(keys, np.arange(len(words) + 2, dtype=np.int64) * rows)
    del keys, order, pairs, codes

    def put(word: np.ndarray, vectors: np.ndarray, there: np.ndarray, lengths: np.ndarray) -> None:
        each = first[word + 1] - first[word]
        total = np.cumsum(each)
        for start in range(0, int(total[-1]) if len(total) else 0, PAIRS_AT_ONCE):
            place = np.arange(start, min(start + PAIRS_AT_ONCE, int(total[-1])))
            of = np.searchsorted(total, place, "right")
            at = first[word[of]] + place - (total[of] - each[of])
            by = np.argsort(row_of[at], kind="stable")
            at, of = at[by], of[by]
            row, begin = np.unique(row_of[at], return_index=True)
            n = times[at][:, None]
            sums[row] += np.add.reduceat(vectors[of] * n, begin)
            counts[row] += np.add.reduceat(there[of] * n, begin)
            reach[row] = np.maximum(reach[row], np.maximum.reduceat(lengths[of], begin))

    met = np.zeros(len(words) + 1, bool)
    for tokens, vectors in blocks():
        found = pc.index_in(tokens, value_set=words)
        which = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False) & tokens.is_valid().to_numpy(zero_copy_only=False))
        if len(which):
            word = found.take(pa.array(which)).to_numpy()
            met[word] = True
            put(word, *_dense(vectors.take(pa.array(which)), width))
    lost = np.flatnonzero(~met)
    one = _dense(pa.array([fallback], pa.list_(pa.float64())), width)
    put(lost, *(np.broadcast_to(x, (len(lost), *x.shape[1:])) for x in one))
    return sums, counts, reach


def _packed_sums(cells: DataFrame, key: str) -> DataFrame:
    summed = cells.groupBy(key, "dim").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    packed = summed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("dim", "s", "n"))).alias("_c"))
    nothing = F.lit(0.0)
    return packed.select(key, F.transform("_c", lambda c: F.coalesce(c["s"], nothing)).alias("sums"), F.transform("_c", lambda c: c["n"]).alias("counts"))


def mean_embedding(embedded: DataFrame, key: str) -> DataFrame:
    """Average vector per key, reduced before the shuffle: (key, dim, value). Takes the rows of ``embed``, added up or not."""
    if "sums" not in embedded.columns:
        cells = explode_rows(embedded, "vector", [key], "dim", "x")
        return cells.groupBy(key, "dim").agg(F.avg("x").alias("value"))
    cells = explode_rows(embedded.select(key, F.arrays_zip("sums", "counts").alias("_cells")), "_cells", [key], "dim", "x")
    total, n = F.sum("x.sums"), F.sum("x.counts")
    return cells.groupBy(key, "dim").agg(F.when(n > 0, total / n).alias("value"))
