"""Sources and sinks: CSV with strict headers, label decoding, unpivoting, numbered checkpoints, versioned publishing."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import coalesce_blank
from ..storage import Versions, write_bytes


class HeaderError(ValueError):
    """A header that lacks a column, repeats one or has a blank one."""


def checked_header(names: list[str | None], required: list[str] | None = None) -> list[str]:
    """Trimmed names without a byte-order mark; HeaderError if one is blank, repeats or is missing."""
    names = [(n or "").lstrip("\ufeff").strip() for n in names]
    if not names or len(set(names)) != len(names) or any(not n for n in names):
        raise HeaderError(f"blank or repeated column in {names}")
    if missing := set(required or ()) - set(names):
        raise HeaderError(f"missing columns {sorted(missing)}")
    return names


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """All columns as text; a byte-order mark is dropped; every file's header is the same one, whatever its width and its
    line breaks; rows longer than the header fail when they are read."""
    reader = spark.read.option("multiLine", True).option("escape", '"')
    heads = _heads(spark, path).groupBy("head").agg(F.count("*").alias("files"), F.min("path").alias("path")).limit(3).collect()  # one job, whatever the files
    if not heads:
        raise HeaderError(f"no file at {path}")
    headers = {tuple(checked_header(r["head"], required)) for r in heads}
    if len(headers) > 1:
        raise HeaderError(f"files have different headers, among them {', '.join(sorted(r['path'] for r in heads))}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in headers.pop()])
    return reader.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST").csv(path)


def _heads(spark: SparkSession, path: str) -> DataFrame:
    """path and head (array of text) of each file that has a line: its first record, which may have line breaks in quotes.
    Only files' first blocks are read, line by line; a file of any size will do."""

    def first(batches):
        import csv

        at, lines = None, []
        for b in batches:
            found = []
            for p, line in zip(b["path"], b["value"], strict=True):
                if p != at:
                    at, lines = p, []
                elif lines is None:
                    continue
                lines.append(line)
                if sum(x.count('"') for x in lines) % 2 == 0:
                    found.append((p, next(csv.reader(["\n".join(lines)]), [])))
                    lines = None
            yield b.iloc[: len(found)][[]].assign(path=[p for p, _ in found], head=[h for _, h in found])

    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")
    return rows.where("start = 0").select("path", "value").mapInPandas(first, "path string, head array<string>")


def _sheet_rows(body: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of a workbook as text, by the package's own XML: shared, inline and plain values."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(body)) as z:
        names = z.namelist()
        texts = lambda e: "".join(t.text or "" for t in e.iterfind(".//m:t", ns))
        shared = [texts(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)] if "xl/sharedStrings.xml" in names else []
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n).group()))
        active = 0
        if "xl/workbook.xml" in names:
            view = ElementTree.fromstring(z.read("xl/workbook.xml")).find(".//m:workbookView", ns)
            active = int(view.get("activeTab", "0")) if view is not None else 0
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[min(active, len(sheets) - 1)])).iterfind(".//m:row", ns):
            cells: list[str | None] = []
            for c in row.iterfind("m:c", ns):
                letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = 0
                for x in letters.group() if letters else "":
                    at = at * 26 + ord(x) - 64
                cells += [None] * ((at or len(cells) + 1) - 1 - len(cells))
                v = c.find("m:v", ns)
                value = texts(c) if c.get("t") == "inlineStr" else shared[int(v.text)] if v is not None and c.get("t") == "s" else v.text if v is not None else None
                cells.append(value)
            rows.append(cells)
    return rows


def read_xlsx(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """The active sheet of a workbook (a small file) as text: strict header, blank rows passed over, HeaderError for values
    beyond the header."""
    body = spark.read.format("binaryFile").load(path).select("content").first()
    rows = _sheet_rows(bytes(body[0]))
    names = checked_header(rows[0] if rows else [], required)
    kept = []
    for r in rows[1:]:
        if all(v is None or not v.strip() for v in r):
            continue
        if any(v is not None for v in r[len(names) :]):
            raise HeaderError("a row has values beyond the header")
        kept.append((r + [None] * len(names))[: len(names)])
    return spark.createDataFrame(kept, T.StructType([T.StructField(n, T.StringType()) for n in names]))


#: Columns of a canonical question file, and words that name an intent.
CANONICAL = "question_id course_code intent difficulty english_question bangla_question banglish_question ground_truth_answer_en ground_truth_answer_bn ground_truth_answer_banglish expected_source expected_page ground_truth_status notes".split()
INTENT_NAMES = (("prerequisite", r"\bpre-?\s*requisite"), ("credits", r"\bcredits?\b"), ("assessment", r"\bmarks?\b|\bexam|\battendance\b"), ("topics", r"\btopics?\b|\bcontent\b"), ("policy", r"\bpolic(?:y|ies)\b|\brules?\b"))


def canonical_questions(rows: DataFrame) -> DataFrame:
    """A workbook's questions in the 14 canonical columns: course code and intent are read from the English question where
    the workbook has none; ids are made from the row's texts where they are missing."""
    from ..functions import understanding as U

    own = {c: first_of(rows, [c, c.replace("_", " ").title()]) for c in CANONICAL}
    own["english_question"] = first_of(rows, ["english_question", "English Query", "english_query", "question_en", "Question"])
    own["bangla_question"], own["banglish_question"] = first_of(rows, ["bangla_question", "Bengali Query", "bengali_query", "question_bn"]), first_of(rows, ["banglish_question", "Banglish Query", "banglish_query", "question_bl"])
    own["ground_truth_answer_en"] = first_of(rows, ["ground_truth_answer_en", "Expected Answer (Ground Truth)", "Expected Answer", "Reference Answer", "answer"])
    said = F.lower(F.coalesce(own["english_question"], F.lit("")))
    named = F.lit("general")
    for name, pattern in reversed(INTENT_NAMES):
        named = F.when(said.rlike(pattern), name).otherwise(named)
    own["course_code"] = F.coalesce(own["course_code"], F.get(F.transform(U.course_entities(own["english_question"]), lambda e: e["canonical"]), F.lit(0)))
    own["intent"] = F.coalesce(own["intent"], named)
    own["question_id"] = F.coalesce(own["question_id"], F.concat(F.lit("Q-"), F.substring(F.sha2(F.concat_ws("\n", own["english_question"], own["bangla_question"], own["banglish_question"]), 256), 1, 12)))
    return rows.select(*[own[c].alias(c) for c in CANONICAL])


def first_of(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that df has and that is not blank, trimmed; null if there is none."""
    have = [coalesce_blank(F.col(f"`{n}`").cast("string")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def aliased(df: DataFrame, names: dict[str, list[str]]) -> DataFrame:
    """Canonical columns, each the first of its aliases that is not blank; aliases that df lacks are passed over."""
    return df.select(*[(coalesce_blank(*[F.col(a) for a in aliases if a in df.columns]) if set(aliases) & set(df.columns) else F.lit(None).cast("string")).alias(n) for n, aliases in names.items()])


def per_language(df: DataFrame, key: str, columns: dict[str, str], name: str = "question") -> DataFrame:
    """One row for each language that has a text: key, language, text."""
    pairs = ", ".join(f"'{lang}', {column}" for lang, column in columns.items())
    return df.selectExpr(key, f"stack({len(columns)}, {pairs}) as (language, {name})").where(F.trim(F.coalesce(name, F.lit(""))) != "")


def labels(value: Column) -> Column:
    """Labels of a cell: a JSON array, or parts between ';' or '|', trimmed, without blanks, each once."""
    plain = F.split(F.coalesce(value, F.lit("")), r"\s*[;|]\s*")
    parsed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(parsed, plain), lambda x: F.trim(x)), lambda x: x != ""))


def nested_as_json(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text, for CSV."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, as a new version below `path`: csv_folder() says where the current one is, and a writer that fails
    or ends before its commit leaves the old one in force."""
    Versions(df.sparkSession, path).publish(lambda folder: nested_as_json(df).write.option("header", True).option("escape", '"').csv(folder))


def csv_folder(spark: SparkSession, path: str) -> str:
    """The folder of the current version that write_csv() made; FileNotFoundError if there is none."""
    found = Versions(spark, path).current()
    if found is None:
        raise FileNotFoundError(path)
    return found["path"]


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """One small JSON file with sorted keys, whole or not at all."""
    write_bytes(spark, path, (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())


def append_log(df: DataFrame, path: str) -> None:
    """Rows as JSON lines after those that are there."""
    df.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last row of each key of a log, by `at`; cells that do not fit the schema are null."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "at").alias("_r")).select(key, "_r.*")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Text columns as the kinds that a checkpoint lost; what does not fit is null, JSON for nested kinds."""
    made = {c: F.from_json(c, k) if k.startswith(("array", "struct", "map")) else F.col(c).try_cast(k) for c, k in kinds.items()}
    return df.withColumns(made)


class CheckpointError(ValueError):
    """Checkpoints that do not belong together."""


def write_checkpoint(rows: DataFrame, path: str, batch: int, run: str) -> None:
    rows.withColumn("batch_number", F.lit(batch)).withColumn("compatibility", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_number").parquet(path)


def read_checkpoint(spark: SparkSession, path: str, key: str, run: str) -> DataFrame:
    """All batches; an error if numbers are missing, a batch is of another run or a key is null or repeats."""
    rows = spark.read.parquet(path)
    seen = rows.agg(F.count_distinct("batch_number").alias("n"), F.min("batch_number").alias("low"), F.max("batch_number").alias("high"), F.count_if(~F.col("compatibility").eqNullSafe(F.lit(run))).alias("other"), F.count_if(F.col(key).isNull()).alias("blank")).first()
    if seen["n"] and (seen["low"], seen["high"]) != (1, seen["n"]):
        raise CheckpointError(f"{seen['n']} batches from {seen['low']} to {seen['high']} are not contiguous")
    if seen["other"]:
        raise CheckpointError("checkpoint of another run")
    if seen["blank"] or rows.groupBy(key).count().where("count > 1").limit(1).count():
        raise CheckpointError("missing or repeated keys")
    return rows


def publish(tables: dict[str, DataFrame], root: str, check, on: int | None = None) -> int:
    """Writes tables to a new version, checks them as read back, and only then commits it; its number. A failure before that
    leaves the old version in force; storage.Conflict if another writer has committed meanwhile."""
    spark = next(iter(tables.values())).sparkSession

    def write(folder: str) -> dict:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        return {"tables": sorted(tables)}

    return Versions(spark, root).publish(write, lambda folder: check({name: spark.read.parquet(f"{folder}/{name}") for name in tables}), on)["number"]


def current(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    found = Versions(spark, root).current()
    if found is None:
        raise FileNotFoundError(root)
    return {name: spark.read.parquet(f"{found['path']}/{name}") for name in found["tables"]}


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of an aggregate; says how many rows it leaves out beyond `most`."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]]
    return "\n".join(lines + ([f"\n{df.count() - most} rows more"] if len(rows) > most else []))


def report(title: str, sections: dict[str, DataFrame]) -> str:
    """A Markdown report: a heading and a table for each section."""
    return "\n\n".join([f"# {title}", *[f"## {name}\n\n{markdown(df)}" for name, df in sections.items()]]) + "\n"
