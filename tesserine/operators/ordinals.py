"""Places in the order of a whole table, without a window over it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def numbered(rows: DataFrame, keys: list[Column], name: str = "ordinal", start: int = 0) -> DataFrame:
    """rows with their place (start, start + 1, ...) in the order of the keys; rows alike in all keys go by a hash of all
    columns, so the numbers do not depend on the partitions (rows alike in all columns are interchangeable).

    Rows are range partitioned, so also a key that most rows share is cut by the hash; each partition's rows are counted on
    from those of the partitions before it. What goes to the driver and into the plan is a number for each partition.
    """
    taken = {c.lower() for c in rows.columns}
    n, tie = (next(x for i in range(len(taken) + 1) if (x := f"{base}{i}") not in taken) for base in ("place", "tie"))
    marked = rows.withColumn(tie, F.xxhash64(*[F.col(f"`{c}`").cast("string") if t.startswith("map") else F.col(f"`{c}`") for c, t in rows.dtypes]))
    order = [*keys, F.col(tie)]
    dealt = stored(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(n, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(n, 33)
    sizes = {r[0]: r[1] for r in dealt.groupBy(part.alias("part")).count().collect()}
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=start))
    base = F.get(F.array(*[F.lit(b) for b in before]), part.cast("int"))
    return dealt.withColumn(name, (base + F.col(n).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(n, tie)


def embedding_rows(chunks: DataFrame) -> DataFrame:
    """chunk_id, vector_row and embedding_content_sha256 of chunks: their rows in a vector table, in the order of path (or
    source), page, block and chunk, and the digest of the text that a vector stands for. Missing columns count as empty."""
    has = lambda *names: [F.col(c) for c in names if c in chunks.columns]
    text = lambda *columns: F.lower(F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns], F.lit("")))
    plain = lambda *columns: F.coalesce(*[c.cast("string") for c in columns], F.lit(""))
    page = F.coalesce(*[c.cast("long") for c in has("page")], F.lit(0).cast("long"))
    slim = chunks.select("chunk_id", text(*has("relative_path", "source")).alias("path"), page.alias("page"), plain(*has("block_id")).alias("block"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("embedding_content_sha256"))
    order = [F.col("path"), F.col("page"), F.col("block"), F.col("chunk_id").cast("string")]
    return numbered(slim, order, "vector_row").select("chunk_id", "vector_row", "embedding_content_sha256")
