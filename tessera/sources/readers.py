"""Readers of tables, FASTA and record texts, structure files and metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import ENDPOINTS, parse_boolean, positive_fraction, row_status
from ..functions.names import path_part
from ..functions.sequences import normalize_sequence, sequence_id
from ..operators.evidence import passing, source_columns

# Folders of each endpoint, files of each status, columns that are never sources.
FOLDERS = {e: (e,) for e in ENDPOINTS} | {"cytolysis": ("cytolysis", "cytolytic")}
STATUS_FILES = {"positive": "positive.csv", "negative": "negative.csv", "ambiguous": "ambiguous_data.csv", "unlabeled": "only_unlabel.csv"}
AUXILIARY = (
    "sequence", "task", "label", "status", "Category_pbb", "category_pbb", "counts_0", "counts_1", "counts_2", "counts_unlabel", "counts_unknown", "count_0", "count_1", "count_2", "count_unlabel", "count_unknown",
    "positive", "negative", "exclusive_0", "exclusive_1", "only_unlabel", "percentage_0", "percentage_1", "positive_support", "is_canon", "filter_length", "length",
)
THREE_TO_ONE = {"ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, header: bool = True, sep: str = ",", skip_rows: int = 0) -> DataFrame:
    """CSV or TSV without inference: all columns are text unless a schema is given. skip_rows drops the first lines of every file."""
    if skip_rows:
        lines = spark.read.text(path).withColumn("__n", F.row_number().over(_file_order())).where(F.col("__n") > skip_rows).select("value")
        return spark.read.csv(lines.rdd.map(lambda r: r.value), header=header, sep=sep, schema=schema)
    reader = spark.read.option("header", header).option("sep", sep).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def _file_order():
    from pyspark.sql import Window

    return Window.partitionBy("_metadata.file_path").orderBy("_metadata.file_block_start", F.monotonically_increasing_id())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension: .parquet, .csv, .tsv, .json or .jsonl, the last four also gzipped; of an .xlsx the first sheet."""
    name = path.removesuffix(".gz")
    if name.endswith(".parquet"):
        return spark.read.parquet(path)
    if name.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if name.endswith((".csv", ".tsv")):
        return read_csv(spark, path, sep="\t" if name.endswith(".tsv") else ",")
    if name.endswith(".xlsx"):
        from .sheets import read_sheet

        return read_sheet(spark, path)
    raise ValueError(f"unknown extension: {path}")


def discover_status_files(spark: SparkSession, root: str) -> DataFrame:
    """(endpoint, folder, declared_status, path, exists) of all files that may be there."""
    rows = [(e, f, s, path := f"{root}/{f}/{n}", _exists(spark, path)) for e in ENDPOINTS for f in FOLDERS[e] for s, n in STATUS_FILES.items()]
    return spark.createDataFrame(rows, "endpoint string, folder string, declared_status string, path string, exists boolean")


def read_status_file(spark: SparkSession, path: str, endpoint: str, folder: str, declared: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(long source evidence, row records, source columns) of one status file, quality control applied."""
    raw = read_csv(spark, path)
    if "sequence" not in raw.columns:
        raise ValueError(f"no column sequence in {path}")
    sources = source_columns(raw, AUXILIARY)
    df = passing(raw, "sequence")
    col = lambda c, t: F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)
    flag = lambda c: parse_boolean(F.col(c)) if c in df.columns else F.lit(False)
    status = row_status(flag("positive"), flag("negative"), flag("only_unlabel"), col("counts_1", "double"), col("counts_0", "double"), F.lit(declared))
    named = df.withColumns({"endpoint": F.lit(endpoint), "input_endpoint_folder": F.lit(folder), "declared_status": F.lit(declared), "row_status": status, "input_file": F.lit(path.rsplit("/", 1)[-1])})
    category = F.coalesce(*(F.col(c) for c in ("Category_pbb", "category_pbb") if c in df.columns), F.lit(None).cast("string"))
    rows = named.select("sequence", "endpoint", "input_endpoint_folder", "declared_status", "row_status", (F.col("row_status") != F.col("declared_status")).alias("status_file_mismatch"), "input_file", positive_fraction(col("percentage_1", "double"), col("counts_1", "double"), col("counts_0", "double")).alias("fraction"), category.alias("category"), F.struct("input_file", "sequence").alias("pos"))
    if not sources:
        long = named.select("sequence", "endpoint", "input_endpoint_folder", "row_status", "input_file").limit(0).withColumns({"source": F.lit(""), "label": F.lit(0)})
    else:
        keep = [F.col(s).try_cast("double").cast("int").alias(s) for s in sources]
        long = named.select("sequence", "endpoint", "input_endpoint_folder", "row_status", "input_file", *keep).unpivot(["sequence", "endpoint", "input_endpoint_folder", "row_status", "input_file"], sources, "source", "label").where("label in (0, 1, 2)")
    return long, rows, sources


def collect_inputs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict[str, list[str]]]:
    """All status files that exist, put together by name, and the source columns of each."""
    found = [r for r in discover_status_files(spark, root).collect() if r.exists]
    if not found:
        raise FileNotFoundError(f"no status file under {root}")
    parts = [(r.path, *read_status_file(spark, r.path, r.endpoint, r.folder, r.declared_status)) for r in found]
    union = lambda frames: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union([p[1] for p in parts]), union([p[2] for p in parts]), {p[0]: p[3] for p in parts}


def load_if_nonempty(spark: SparkSession, statistics: Mapping, key: str, path: str) -> DataFrame | None:
    """The table at path only if the metadata entry says that it has rows: a number over 0, n_sequences over 0, or numbers that sum up to over 0."""
    entry = statistics.get(key)
    if isinstance(entry, Mapping):
        count = entry["n_sequences"] if "n_sequences" in entry else sum(v for v in entry.values() if isinstance(v, (int, float)) and not isinstance(v, bool))
    else:
        count = entry if isinstance(entry, int) else 0
    return read_csv(spark, path) if count and count > 0 else None


def labelled_sequences(positive: DataFrame, negative: DataFrame) -> DataFrame:
    return positive.select("sequence", F.lit("Positive").alias("label")).unionByName(negative.select("sequence", F.lit("Negative").alias("label")))


def read_same_named(spark: SparkSession, root: str, filename: str, recursive: bool = True) -> DataFrame:
    """The sequence column of all files of one name under root."""
    reader = spark.read.option("header", True).option("pathGlobFilter", filename).option("recursiveFileLookup", recursive)
    return reader.csv(root).select("sequence")


def read_folders(spark: SparkSession, root: str, target: str, parts: Sequence[str] = ("ts", "tc")) -> DataFrame:
    """CSV files two folders deep with the folders' names as columns, and a constant target."""
    df = spark.read.option("header", True).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).csv(root).select("*", F.col("_metadata.file_path").alias("__path"))
    names = {p: path_part(F.col("__path"), i - len(parts) - 1) for i, p in enumerate(parts)}
    return df.withColumns(names).withColumn("target", F.lit(target)).drop("__path")


def split_inventory(spark: SparkSession, root: str, filename: str = "train.csv") -> DataFrame:
    """(dataset, strategy, seed, fold) from the paths root/dataset/strategy/seed_n/fold_n/train.csv; files aren't read, hidden folders are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", filename).option("recursiveFileLookup", True).load(root).select("path").where("path not like '%/.%'")
    number = lambda c: F.regexp_extract(c, r"([0-9]+)$", 1).try_cast("int")
    return files.select(path_part(F.col("path"), -5).alias("dataset"), path_part(F.col("path"), -4).alias("strategy"), number(path_part(F.col("path"), -3)).alias("seed"), number(path_part(F.col("path"), -2)).alias("fold"))


def read_summaries(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """All summaries of a name pattern with the model from the file name; files that can't be read are left out."""
    df = spark.read.option("header", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).csv(root)
    return df.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_summary)?\.csv$", 1).alias("model"))


def read_fasta(spark: SparkSession, path: str, whole_header: bool = False, description: bool = False) -> DataFrame:
    """(id, sequence[, description]). Records are the splits of the file, so a large file is read in parallel; malformed UTF-8 becomes U+FFFD."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"\A>", "").alias("v")).where("trim(v) <> ''")
    header = F.trim(F.replace(F.substring_index("v", "\n", 1), F.lit("\r"), F.lit("")))
    ident = header if whole_header else F.regexp_extract(header, r"^(\S*)", 1)
    seq = F.regexp_replace(F.when(F.instr("v", "\n") > 0, F.substring(F.col("v"), F.instr("v", "\n") + 1, F.char_length("v"))).otherwise(""), r"\s+", "")
    return rec.select(ident.alias("id"), seq.alias("sequence"), *([header.alias("description")] if description else []))


def read_fasta_broken_headers(spark: SparkSession, path: str) -> DataFrame:
    """FASTA whose headers run over several lines: only lines of capital letters are sequence, the others belong to the header."""
    rec = spark.read.option("lineSep", "\n>").text(path).select(F.split(F.regexp_replace("value", r"\A>", ""), r"\r?\n").alias("l")).where("trim(l[0]) <> ''")
    rest = F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0)))
    is_seq = lambda x: F.rtrim(x).rlike("^[A-Z]+$")
    extra = F.transform(F.filter(rest, lambda x: ~is_seq(x) & (F.trim(x) != "")), lambda x: F.trim(x))
    header = F.array_join(F.concat(F.array(F.rtrim(F.col("l")[0])), extra), " ")
    return rec.select(F.regexp_extract(header, r"^(\S*)", 1).alias("id"), header.alias("description"), F.array_join(F.transform(F.filter(rest, is_seq), lambda x: F.rtrim(x)), "").alias("sequence"))


def read_adam(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence, length) of tab-separated records that start with ADAM_ and a number; further lines continue the sequence."""
    rec = spark.read.option("lineSep", "\nADAM_").text(path).select(F.regexp_replace("value", r"\A\s*ADAM_", "").alias("v")).where(r"v rlike '\\A[0-9]+'")
    lines = rec.select(F.filter(F.transform(F.split("v", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "").alias("l")).select("l", F.split(F.col("l")[0], "\t").alias("p"))
    seq = F.regexp_replace(F.concat(F.element_at("p", -1), F.array_join(F.slice("l", F.lit(2), F.greatest(F.size("l") - 1, F.lit(0))), "")), " ", "")
    description = F.when(F.size("p") > 2, F.trim(F.array_join(F.slice("p", F.lit(2), F.greatest(F.size("p") - 2, F.lit(0))), "\t"))).otherwise("")
    return lines.select(F.concat(F.lit("ADAM_"), F.trim(F.col("p")[0])).alias("id"), description.alias("description"), seq.alias("sequence"), F.char_length(seq).alias("length"))


def read_apd(spark: SparkSession, path: str) -> DataFrame:
    """(id, description, sequence) of lines AP and a number, each followed by a line whose last word is the sequence; lines of the page around them are left out. A file is one row."""
    skip = F.lit(r"^(Found|Or you can also select|Search again|Home)")
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.regexp_like(x, skip))
    pairs = F.zip_with(F.col("l"), F.slice("l", F.lit(2), F.size("l")), lambda a, b: F.struct(a.alias("id"), b.alias("info")))
    rec = spark.read.text(path, wholetext=True).select(lines.alias("l")).select(F.explode(pairs).alias("r")).where(r"r.id rlike '^AP[0-9]+' and r.info is not null")
    words = F.split("r.info", r"\s+")
    return rec.select("r.id", F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " ").alias("description"), F.element_at(words, -1).alias("sequence"))


def read_pdb(spark: SparkSession, path: str, standard_only: bool = True) -> DataFrame:
    """(file, chain, sequence) by the residues of ATOM lines in order; a blank chain is A. Residues that aren't standard are left out, or X."""
    codes = F.create_map(*(F.lit(x) for kv in THREE_TO_ONE.items() for x in kv))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")))
    atoms = files.where("col like 'ATOM  %'").select("file", "pos", F.coalesce(F.nullif(F.trim(F.substring("col", 22, 1)), F.lit("")), F.lit("A")).alias("chain"), F.substring("col", 23, 5).alias("residue"), F.trim(F.substring("col", 18, 3)).alias("name"))
    firsts = atoms.groupBy("file", "chain", "residue", "name").agg(F.min("pos").alias("pos")).withColumn("one", F.try_element_at(codes, F.col("name")))
    firsts = firsts.where("one is not null") if standard_only else firsts.fillna("X", subset=["one"])
    return firsts.groupBy("file", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: x["one"]), "").alias("sequence"))


def file_membership(files: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, known): the stem of each path with | for _, and whether ids has it."""
    stems = files.select(F.replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit("|")).alias("id")).distinct()
    return stems.join(ids.select("id", F.lit(True).alias("known")).distinct(), "id", "left").fillna({"known": False})


def read_json_metadata(spark: SparkSession, root: str, name: str = "metadata.json") -> DataFrame:
    """(folder, text, valid) of every metadata file; text that isn't JSON is reported, not raised."""
    df = spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root, wholetext=True)
    return df.select(path_part(F.col("_metadata.file_path"), -2).alias("folder"), F.col("value").alias("text"), F.try_parse_json("value").isNotNull().alias("valid"))


def read_metadata(spark: SparkSession, path: str, source: str | None = None, exact: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Source metadata from CSV or the first sheet of a workbook, rows of one source by name or by a part of it without case."""
    df = read_table(spark, path)
    name = F.col("`name source`")
    if source is not None:
        df = df.where(name == source if exact else F.lower(name).contains(source.lower()))
    return df.select(*(f"`{c}`" for c in columns)) if columns else df


def read_measurements(spark: SparkSession, root: str) -> DataFrame:
    """Regression datasets processed_TYPE_dataset.csv of all folders, with the type and the source dataset's folder."""
    df = spark.read.option("header", True).option("pathGlobFilter", "processed_*_dataset.csv").option("recursiveFileLookup", True).csv(root)
    return df.select("*", F.nullif(F.regexp_extract(F.col("_metadata.file_name"), r"^processed_(HC50|LC50|LD50|MHC)_dataset\.csv$", 1), F.lit("")).alias("measurement_type"), path_part(F.col("_metadata.file_path"), -2).alias("source_dataset")).where("measurement_type is not null")


def id_set(df: DataFrame) -> DataFrame:
    """Different ids: the column id, or made from sequence."""
    ident: Column = F.col("id") if "id" in df.columns else sequence_id(normalize_sequence(F.col("sequence")))
    return df.select(F.explode(F.filter(F.array(ident), lambda x: x.isNotNull())).alias("id")).distinct()


def feature_columns(df: DataFrame, exclude: Sequence[str] = ("id", "sequence", "label")) -> list[str]:
    """p_0, p_1 .. in numeric order; if there are none, all numeric columns but those excluded."""
    import re

    named = sorted((c for c in df.columns if re.fullmatch(r"p_\d+", c)), key=lambda c: int(c[2:]))
    return named or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def representation_for(df: DataFrame, ids: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features of the wanted ids, one row each."""
    return df.select("id", *features).join(ids.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])


def zip_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows side by side by position; the row counts must be equal. Carry an id instead where there is one."""
    names = [*left.columns, *right.columns]
    if len(set(names)) < len(names):
        raise ValueError("columns clash")
    index = lambda df: df.rdd.zipWithIndex().map(lambda r: (r[1], *r[0])).toDF(T.StructType([T.StructField("__i", T.LongType()), *df.schema.fields]))
    a, b = index(left), index(right)
    if left.count() != right.count():
        raise ValueError("row counts differ")
    return a.join(b, "__i").drop("__i")
