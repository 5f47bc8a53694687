"""What the training-data operators share: column names, text folding, scratch tables."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DOUBLE = re.compile(r"\s ")
#: Finds a blank before a space.
blank_before_space = _DOUBLE.search
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that end a word of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, as a Java pattern.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not use yet (names are compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.  Pure ASCII takes lower(), which is much faster than translate()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text; null and blank text have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), lambda w: w != "")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for a scratch table, in the shared folder named by spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = f"file://{tempfile.mkdtemp(prefix='halfeven-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/halfeven/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet to the shared scratch folder and reads it back.

    This cuts the lineage: a lost executor costs no earlier stage, and what was written
    does not change when a task is run again.  Rows are rebalanced first, so that a stage of many
    tasks with little output each leaves few files.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.hint("rebalance").write.parquet(path)
    return spark.read.schema(df.schema).parquet(forget_at_exit(spark, path))


def forget_at_exit(spark: SparkSession, path: str) -> str:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_scratch(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes scratch folders that no later step reads."""
    for path in paths:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Texts go to Python in Arrow batches of some megabytes.  The default of 64 MB, held twice by a task of the JVM and once more
    by its Python worker, takes a third of a small executor."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", size), ("spark.sql.execution.arrow.maxRecordsPerBatch", size >> 11)):
        if int(spark.conf.get(key).rstrip("b")) > value:
            spark.conf.set(key, str(value))


def tidy(run):
    """A function for mapInArrow that gives its worker's free memory back to the machine when a task ends.

    Workers live on and take the next operator's tasks; what the allocators keep would add up beside the JVM.
    """

    @functools.wraps(run)
    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def slices(texts, most: int = 1 << 22):
    """Runs [begin, end) of an Arrow string array whose texts have some megabytes together (or one long text)."""
    import pyarrow.compute as pc

    begin, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def cut(text: str) -> list[str]:
    """Cuts a text where a byte-level tokenizer surely starts a new piece: at a space that follows a non-blank.

    Pieces of `public_tokenizers.PATTERN` never run across such a place and never look past it, so the ids of a text are
    those of its first part, then those of a space and each further part in turn; equal parts need to be encoded once.
    """
    if not _DOUBLE.search(text):
        return text.split(" ") if text[:1] != " " else ["", *text[1:].split(" ")]
    first, *rest = re.split(r"(?<=\S)(?= )", text)
    return [first, *[x[1:] for x in rest]]


def encode_parts(texts: list[str], parts_of, heads_of) -> list[bytes]:
    """The ids of each text as little-endian 32-bit integers, from those of its distinct parts.

    `parts_of(parts)` gives (ids, lengths) of a space and each part of an Arrow array, in turn; `heads_of(heads)` those of
    the texts' first parts.  Splitting, finding equal parts and putting the ids together run on whole arrays.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    plain = [not t.startswith(" ") and _DOUBLE.search(t) is None for t in texts]
    order = [k for k, p in enumerate(plain) if p] + [k for k, p in enumerate(plain) if not p]
    n = sum(plain)
    split = pc.split_pattern(pa.array([texts[k] for k in order[:n]], pa.large_string()), " ")
    others = [cut(texts[k]) for k in order[n:]]
    sizes = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(o) for o in others], dtype=np.int64)]).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    values = pa.concat_arrays([split.flatten(), pa.array([p for o in others for p in o], pa.large_string())])
    coded = values.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    ids, lengths = parts_of(coded.dictionary)
    head_ids, head_lengths = heads_of(values.take(pa.array(first)).to_pylist())
    place[first] = len(lengths) + np.arange(len(texts))
    pool, lengths = np.concatenate([ids, head_ids]), np.concatenate([lengths, head_lengths])
    starts = np.cumsum(lengths) - lengths
    each = lengths[place]
    ends = np.cumsum(each)
    raw = pool[np.repeat(starts[place] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    out: list = [b""] * len(texts)
    begin = 0
    for k, end in zip(order, (ends[first + sizes - 1] * 4).tolist() if len(texts) else (), strict=True):
        out[k] = raw[begin:end]
        begin = end
    return out
