"""Loading minimal pairs: discovery, CSV/JSON/JSONL scans, checks and normalisation."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlight.functions.text import first_present, missing
from pairlight.storage import materialize

# Accepted endings and the field aliases in order.
EXTENSIONS = (".csv", ".json", ".jsonl")
UID_ALIASES = ("uid", "UID", "pair_id")
PAIR_ALIASES = ("pairID",)
PHENOMENON_ALIASES = ("phenomenon", "linguistics_term", "linguistic_term")
FALLBACK = "field"
FILTER_FIELDS = ("phenomenon", "subtype", "UID", "linguistics_term", "linguistic_term", "field")
SUBTYPE_ALIASES = ("subtype", "linguistic_term", "linguistics_term", "field")
CORE = {"sentence_good", "sentence_bad"}


Get = Callable[[str], Column]


def _first(names: Sequence[str], get: Get) -> Column:
    return first_present(*[get(n) for n in names]) if names else F.lit(None).cast("string")


def _of(columns: Sequence[str] | None, names: Sequence[str]) -> list[str]:
    return [n for n in names if columns is None or n in columns]


def normalized_pair_id(columns: Sequence[str] | None = None, get: Get = F.col) -> Column:
    """``uid-pairID`` where both are there, else whichever is. ``columns``: the fields that there are (all, if not given);
    ``get`` reads one. Names are taken case-sensitively where the reader of the fields does so."""
    uid, pair = _first(_of(columns, UID_ALIASES), get), _first(_of(columns, PAIR_ALIASES), get)
    return F.when(uid.isNotNull() & pair.isNotNull(), F.concat_ws("-", uid, pair)).otherwise(F.coalesce(uid, pair))


def normalized_phenomenon(columns: Sequence[str] | None = None, get: Get = F.col) -> Column:
    return F.coalesce(_first(_of(columns, PHENOMENON_ALIASES), get), _first(_of(columns, [FALLBACK]), get))


def matches_phenomenon(columns: Sequence[str] | None, wanted: str, get: Get = F.col) -> Column:
    """Case-insensitive: any of six fields contains the text."""
    hit = F.lit(False)
    for c in _of(columns, FILTER_FIELDS):
        hit = hit | F.contains(F.lower(F.coalesce(get(c).cast("string"), F.lit(""))), F.lit(wanted.lower()))
    return hit


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _ending(path: str) -> str:
    return Path(_name(path)).suffix.lower()


def discover(path: str, phenomenon: str, spark: SparkSession | None = None) -> list[str]:
    """A file itself if its ending fits; in a folder all fitting files in name order, resource forks left out. If any file
    name holds the phenomenon, only those. With a session any storage that Spark reads is listed, else the local one."""
    if spark is None:
        p = Path(path)
        single, found = p.is_file(), [str(f) for f in p.rglob("*") if f.is_file()] if p.is_dir() else []
    else:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        single, found = fs.exists(at) and fs.getFileStatus(at).isFile(), []
        if fs.exists(at) and not single:
            listed = fs.listFiles(at, True)
            while listed.hasNext():
                uri = listed.next().getPath().toUri()
                found.append(uri.getPath() if uri.getScheme() in (None, "file") else uri.toString())
    if single:
        if _ending(path) not in EXTENSIONS:
            raise ValueError(f"unsupported file type: {path}")
        return [path]
    files = sorted(f for f in found if _ending(f) in EXTENSIONS and not _name(f).startswith("._"))
    if not files:
        raise FileNotFoundError(f"no data file under {path}")
    named = [f for f in files if phenomenon.lower() in _name(f)[: -len(_ending(f))].lower()]
    return named or files


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """Header row, every column text. Without ``multi_line`` large files are split, and no field may hold a line break."""
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


RECORD = "map<string,string>"


def _parsed(text: str, kind: str) -> Column:
    """One JSON value of a type, null where the text is anything else. It is read as the only element of an array, as the
    reader would not mind what follows a value."""
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>")
    return F.when(F.size(listed) == 1, listed[0])


def _csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """One scan for all files with the same header line. Files without a quoted line break, which a first scan tells, are
    read by lines and so split over tasks."""
    headers: dict[str, list[str]] = {}
    for f in files:
        headers.setdefault(next(iter(r.value for r in spark.read.text(f).limit(1).collect()), ""), []).append(f)
    out = None
    for same in headers.values():
        open_quote = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
        rows = read_csv(spark, same, not spark.read.text(same).where(open_quote).limit(1).isEmpty())
        fields = F.create_map(*[x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`"))]) if rows.columns else F.create_map().cast(RECORD)
        part = rows.select(fields.cast(RECORD).alias("record"), F.col("_metadata.file_path").alias("source_file"))
        out = part if out is None else out.unionByName(part)
    return out


def _jsonl_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """One object a line, read as its fields' texts without a schema to be guessed; blank lines are skipped. A line that is
    no object has a null record."""
    lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.length(F.trim("value")) > 0)
    return lines.select(_parsed("value", RECORD).alias("record"), "source_file")


def _json_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """An array of objects, or an object with such an array as ``pairs``; anything else is one null record. A document is
    read whole by one task."""
    docs = spark.read.text(files, wholetext=True).select("value", F.col("_metadata.file_path").alias("source_file"))
    listed = F.coalesce(_parsed("value", f"array<{RECORD}>"), _parsed("value", f"struct<pairs array<{RECORD}>>")["pairs"])
    none = F.array(F.lit(None).cast(RECORD))
    return docs.select(F.explode(F.coalesce(listed, none)).alias("record"), "source_file")


READERS = {".csv": _csv_records, ".jsonl": _jsonl_records, ".json": _json_records}


def raw_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``record`` (a map of the fields' texts, null where something else stands) and ``source_file``: one scan a format."""
    out = None
    for ending, read in READERS.items():
        if own := [f for f in files if _ending(f) == ending]:
            out = read(spark, own) if out is None else out.unionByName(read(spark, own))
    return out


def normalize(raw: DataFrame) -> DataFrame:
    """Core columns and the rest as ``metadata``; no record, or one without sentences, id or phenomenon, is an error.

    ``subtype`` is filled from its aliases only where the record has no such field; a blank one stays. Field names are
    case-sensitive: ``uid`` and ``UID`` may both be there.
    """
    get = lambda c: F.col("record")[c]
    fail = lambda what: F.raise_error(F.concat("source_file", F.lit(f": {what}"))).cast("string")
    checked = lambda c, what: F.when(F.col("record").isNull(), fail("not a JSON object")).when(~missing(c), c).otherwise(fail(f"record without {what}"))
    subtype = F.when(F.map_contains_key("record", "subtype"), get("subtype")).otherwise(_first(SUBTYPE_ALIASES, get))
    used = [*CORE, *UID_ALIASES, *PAIR_ALIASES, "phenomenon", "subtype"]
    return raw.select(
        checked(get("sentence_good"), "sentence_good").alias("grammatical"), checked(get("sentence_bad"), "sentence_bad").alias("ungrammatical"),
        checked(normalized_pair_id(None, get), "an id").alias("pair_id"), checked(normalized_phenomenon(None, get), "a phenomenon").alias("phenomenon"),
        subtype.alias("subtype"), F.map_filter("record", lambda k, v: v.isNotNull() & ~k.isin(*used)).alias("metadata"), "source_file",
    )


def to_pairs(raw: DataFrame) -> DataFrame:
    """Generated records as pairs: ``uid`` and ``sentence_*`` renamed, without an id an empty one, without a phenomenon
    ``agreement``; fields that a file lacks are null."""
    rows = raw.withColumnsRenamed({"uid": "pair_id", "sentence_good": "grammatical", "sentence_bad": "ungrammatical"})
    text = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    default = {"pair_id": "", "phenomenon": "agreement"}
    names = ("pair_id", "phenomenon", "subtype", "template_type", "dependency_distance", "attractor_count", "clause_depth", "grammatical", "ungrammatical")
    return rows.select(*[(F.coalesce(text(c), F.lit(default[c])) if c in default else text(c)).alias(c) for c in names])


def to_records(pairs: DataFrame) -> DataFrame:
    """The other way: pairs under the names of generated records."""
    return pairs.withColumnsRenamed({"pair_id": "uid", "grammatical": "sentence_good", "ungrammatical": "sentence_bad"})


#: Repeated ids that an error message lists; where there are more, all of them are in a table that it names.
LISTED_IDS = 1000


def repeated_ids(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_unique(pairs: DataFrame) -> None:
    """An error that lists the repeated ids, if there are any."""
    again = materialize(repeated_ids(pairs))
    listed = [r.pair_id for r in again.orderBy("pair_id").limit(LISTED_IDS + 1).collect()]
    if listed:
        more = f", ... (all in {again.inputFiles()[0].rsplit('/', 1)[0]})" if len(listed) > LISTED_IDS else ""
        raise ValueError("repeated pair ids: " + ", ".join(listed[:LISTED_IDS]) + more)


def _bad_line(spark: SparkSession, files: list[str]) -> str | None:
    """The first line of the first file, in name order, that is no JSON object, with its number; read only after an error."""
    for f in (f for f in files if _ending(f) == ".jsonl"):
        numbered = F.transform(F.split("value", r"\r?\n"), lambda v, i: F.struct((i + 1).alias("line"), v.alias("value")))
        lines = spark.read.text(f, wholetext=True).select(F.explode(numbered).alias("l")).select("l.*").where(F.length(F.trim("value")) > 0)
        bad = lines.where(_parsed("value", RECORD).isNull()).orderBy("line").limit(1).collect()
        if bad:
            return f"{f}:{bad[0].line}: not a JSON object"
    return None


def load_pairs(spark: SparkSession, path: str, phenomenon: str = "agreement", dataset: str | None = None) -> DataFrame:
    """All pairs under a path that belong to a phenomenon. Ids must be unique over all loaded pairs, before the filter."""
    files = discover(path, phenomenon, spark)
    raw = raw_records(spark, files)
    wanted = matches_phenomenon(None, phenomenon, lambda c: F.col("record")[c])
    try:
        check_unique(normalize(raw))
    except ValueError:
        raise
    except Exception as e:
        if (where := _bad_line(spark, files)) is not None:
            raise ValueError(where) from e
        raise
    kept = normalize(raw.where(wanted))
    return kept.withColumn("dataset", F.lit(dataset)) if dataset else kept


def read_plain_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def read_json_document(path: str) -> dict | list:
    """A configuration-sized document, on the driver."""
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_config(path: str) -> dict:
    """A YAML mapping; an empty file is an empty one, anything else is an error."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if value is None:
        return {}
    if not isinstance(value, dict):
        raise ValueError(f"{path}: a configuration must be a mapping")
    return value


def optional_document(path: str | None) -> dict | None:
    """A baseline summary with its path and name, or None where the path is missing."""
    if not path or not Path(path).is_file():
        return None
    return {**read_json_document(path), "path": path, "name": Path(path).stem.removesuffix("_summary")}


def data_path(path: str | None, raw_dir: str, subset: str) -> str:
    """The explicit path, else ``raw_dir/subset.jsonl`` if it is there, else ``raw_dir``."""
    if path:
        return path
    named = Path(raw_dir) / f"{subset}.jsonl"
    return str(named if named.is_file() else raw_dir)


def read_q_table(spark: SparkSession, path: str) -> DataFrame:
    rows = [(s, a, float(v)) for s, values in read_json_document(path).items() for a, v in values.items()]
    return spark.createDataFrame(rows, "state_key string, action string, q double")
