"""Ingestion: file discovery, descriptors, exact duplicates, status rollups and fingerprints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import hadoop_path


def discover(spark: SparkSession, root: str, suffix: str = "pdf") -> DataFrame:
    """Descriptors of the files below root whose name ends in the suffix, in any case: document_id, relative_path, sha256,
    size_bytes, modificationTime; FileNotFoundError if there are none. Only names are read to find that out."""
    pattern = "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.lower() != c.upper() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no .{suffix} file below {root}")
    fs, at = hadoop_path(spark, root)
    base = fs.resolvePath(at).toUri().getPath().rstrip("/") + "/"  # as the paths of the files are written
    own = F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    relative = F.when(own.startswith(base), F.substring(own, F.lit(len(base) + 1), F.length(own))).otherwise(own)
    out = files.select(relative.alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), "modificationTime")
    return out.withColumn("document_id", document_id(F.col("relative_path"), F.col("sha256")))


def document_id(path, sha):
    return F.concat(F.lit("doc-"), F.substring(F.sha2(F.concat(F.lower(path), F.lit("\0"), sha), 256), 1, 24))


def exact_duplicates(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, sha256, duplicate_of (least key of the same text; null for that one). The digests' least keys are combined in
    each task first, so copies of one text never meet in one."""
    own = docs.select(key, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    first = own.groupBy("sha256").agg(F.min(key).alias("_first"))
    return own.join(first, "sha256").select(key, "sha256", F.when(F.col(key) != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def profile(docs: DataFrame, by: str) -> DataFrame:
    """Status rollup of documents by a column: documents, empty, characters, distinct texts."""
    n = F.length(F.coalesce("text", F.lit("")))
    return docs.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(n == 0).alias("empty"), F.sum(n).alias("characters"), F.round(F.avg(n), 6).alias("mean_characters"), F.count_distinct(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("distinct_texts"))


#: (relative_path, content) -> texts of the pages; None for a page that could not be read. EncryptedError, or any other error
#: for a file that cannot be opened.
Parser = Callable[[str, bytes], list[str | None]]


class EncryptedError(Exception):
    """A file that cannot be read without a password."""


def text_pages(path: str, content: bytes) -> list[str | None]:
    """Pages of a text file: parts between form feeds, as UTF-8; a part that is no text could not be read."""
    out: list[str | None] = []
    for part in content.split(b"\f") if content else []:
        try:
            out.append(part.decode("utf-8"))
        except UnicodeDecodeError:
            out.append(None)
    return out


SCANNED = "document_id string, relative_path string, duplicate_of string, page int, text string, error string"


def scan(files: DataFrame, parse: Parser = text_pages) -> DataFrame:
    """Pages of files (document_id, relative_path, sha256, content), one row each, with what went wrong in `error`.

    Of files with the same content the first by lower-case path is read, the others are one row with duplicate_of. A file
    that cannot be opened or has no pages is one row without a page; a page that cannot be read costs only itself.
    """
    low = F.struct(F.lower("relative_path").alias("p"), "document_id")
    first = files.groupBy("sha256").agg(F.min(low)["document_id"].alias("_first"))
    own = files.join(first, "sha256").withColumn("duplicate_of", F.when(F.col("document_id") != F.col("_first"), F.col("_first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, path, twin, content in b[["document_id", "relative_path", "duplicate_of", "content"]].itertuples(index=False):
                head = (doc, path, twin)
                if twin is not None:
                    rows.append((*head, None, None, "duplicate_document"))
                    continue
                try:
                    pages = parse(path, bytes(content))
                except EncryptedError:
                    rows.append((*head, None, None, "encrypted_document"))
                    continue
                except Exception:  # whatever a parser meets, other files are read on
                    rows.append((*head, None, None, "open_error"))
                    continue
                if not pages:
                    rows.append((*head, None, None, "empty_document"))
                rows += [(*head, i, text, "extraction_error" if text is None else "empty_page" if not text.strip() else None) for i, text in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCANNED.split(", ")])

    light = F.when(F.col("duplicate_of").isNull(), F.col("content"))
    return own.select("document_id", "relative_path", "duplicate_of", light.alias("content")).mapInPandas(run, SCANNED)


def pages_and_issues(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with text, issues): an issue for each error, and requires_ocr for a file that has pages and none with text."""
    good = F.col("error").isNull()
    pages = scanned.where(good).select("document_id", "relative_path", "page", T.clean_page(F.col("text")).alias("text"))
    own = scanned.where(~good).select("document_id", "page", F.col("error").alias("issue_type"))
    none = scanned.groupBy("document_id").agg(F.count("page").alias("n"), F.count_if(good).alias("good")).where("n > 0 and good = 0")
    return pages, own.unionByName(none.select("document_id", F.lit(None).cast("int").alias("page"), F.lit("requires_ocr").alias("issue_type")))


def scan_statuses(scanned: DataFrame) -> DataFrame:
    """Per document: pages, good and empty ones, and success, partial, failed or duplicate."""
    good = F.col("error").isNull()
    out = scanned.groupBy("document_id").agg(F.count("page").alias("pages"), F.count_if(good).alias("good"), F.count_if(F.col("error") == "empty_page").alias("empty"), F.count_if(~good).alias("issues"), F.max("duplicate_of").alias("duplicate_of"))
    status = F.when(F.col("duplicate_of").isNotNull(), "duplicate").when(F.col("good") == 0, "failed").when(F.col("issues") > 0, "partial").otherwise("success")
    return out.select("document_id", "pages", "good", "empty", status.alias("status"))


def totals(statuses_: DataFrame) -> DataFrame:
    """One row: documents by status and pages; pages of duplicates do not count."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses_.agg(F.count("*").alias("documents"), *[count(s) for s in ("success", "partial", "failed", "duplicate")], F.coalesce(F.sum(F.when(F.col("status") != "duplicate", F.col("pages"))), F.lit(0)).alias("pages"), F.coalesce(F.sum("good"), F.lit(0)).alias("pages_with_text"))


def identities(files: DataFrame) -> DataFrame:
    """What a corpus is known by: document_id, relative_path, sha256, size_bytes."""
    return files.select("document_id", "relative_path", "sha256", "size_bytes")


def issues(pages: DataFrame) -> DataFrame:
    """(document_id, page, issue_type) of pages whose text is empty or has hardly any letters."""
    t = F.coalesce("text", F.lit(""))
    kinds = F.array_compact(F.array(F.when(F.trim(t) == "", F.lit("empty_page")), F.when((F.trim(t) != "") & (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 10), F.lit("requires_ocr"))))
    return pages.select("document_id", "page", F.explode(kinds).alias("issue_type"))


def statuses(pages: DataFrame) -> DataFrame:
    """Per document: success, partial or failed by how many of its pages have text."""
    good = F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "")
    out = pages.groupBy("document_id").agg(F.count("*").alias("pages"), good.alias("good"))
    return out.withColumn("status", F.when(F.col("good") == F.col("pages"), "success").when(F.col("good") > 0, "partial").otherwise("failed"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table, whatever its order: the digests of rows are added up in 256 buckets first."""
    each = F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)
    part = rows.select(each.alias("h")).groupBy(F.substring("h", 1, 2).alias("b")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return part.agg(F.sum("n").alias("rows"), F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("b", "s", "n")))), 256).alias("fingerprint"))


def without_known(rows: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Rows still to run."""
    return rows.join(done, key, "left_anti")


def latest_version(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
