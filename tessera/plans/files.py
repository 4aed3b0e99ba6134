"""Queries that write to the shared folder and read back: files, records, checksums, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.sequences import normalize_sequence
from ..operators import cards
from ..session import scratch_path
from ..sources import readers, sheets, sinks
from ..streaming import evidence as streaming
from .adapters import RESOLVED, VOTES, table, votes
from .evidence import E, clean, matrix, pivot
from .evidence import HIERARCHY, LABELLED
from .measures import built
from .registry import query


@query(f"WITH {HIERARCHY} SELECT id, sequence FROM pivoted")
def fasta_round_trip(spark, d):
    path = scratch_path(spark, "fasta")
    sinks.write_fasta(pivot(spark, d), path)
    return readers.read_fasta(spark, path)


@query("SELECT 'ADAM_' || p_partkey AS id, p_name || ' (' || p_brand || ')' AS description, repeat('ACDE', 2 + p_size % 3) || 'KLM' AS sequence, (4 * (2 + p_size % 3) + 3)::INT AS length FROM part")
def adam_round_trip(spark, d):
    path = scratch_path(spark, "adam")
    p = table(spark, d, "part")
    seq = F.repeat(F.lit("ACDE"), F.lit(2) + F.col("p_size") % 3)
    value = F.concat(F.lit("ADAM_"), F.col("p_partkey").cast("string"), F.lit("\t"), "p_name", F.lit(" ("), "p_brand", F.lit(")\t"), seq, F.lit("\n  K L\n\nM "))
    p.select(value.alias("value")).write.text(path)
    return readers.read_adam(spark, path)


@query("SELECT 'AP' || lpad(p_partkey::VARCHAR, 5, '0') AS id, p_type || ' ' || p_name AS description, repeat('KL', 3 + p_size % 4) AS sequence FROM part")
def apd_round_trip(spark, d):
    path = scratch_path(spark, "apd")
    p = table(spark, d, "part")
    value = F.concat(F.lit("Home page\nAP"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.lit("\nFound 3\n"), "p_type", F.lit("  "), "p_name", F.lit(" "), F.repeat(F.lit("KL"), F.lit(3) + F.col("p_size") % 4), F.lit("\n"))
    p.select(value.alias("value")).write.text(path)
    return readers.read_apd(spark, path)


@query(f"""WITH {LABELLED}, f AS (SELECT sequence, CASE WHEN positive THEN 'positive' WHEN negative THEN 'negative' ELSE 'ambiguous' END AS row_status FROM voted WHERE NOT only_unlabel)
SELECT row_status, count(*) AS n, count(DISTINCT sequence) AS n_sequences FROM f GROUP BY row_status""")  # fmt: skip
def status_file_scan(spark, d):
    """Status files of one endpoint as the integration writes them, found and read again."""
    from ..operators.evidence import label_votes
    from .adapters import SOURCES

    root = scratch_path(spark, "status")
    voted = label_votes(matrix(spark, d), SOURCES)
    for name, rows in (("positive.csv", voted.where("positive")), ("negative.csv", voted.where("negative")), ("ambiguous_data.csv", voted.where("not positive and not negative and not only_unlabel"))):
        sinks.write_csv(rows, f"{root}/toxic/{name}")
    _, rows, _ = readers.collect_inputs(spark, root)
    return rows.groupBy("row_status").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("n_sequences"))


@query(f"WITH {HIERARCHY} SELECT id, sequence, {', '.join(E)} FROM pivoted")
def csv_round_trip(spark, d):
    path = scratch_path(spark, "csv")
    sinks.write_csv(pivot(spark, d), path, compression="gzip")
    return readers.read_csv(spark, path, "id string, sequence string, " + ", ".join(f"{e} int" for e in E))


@query("""SELECT c_custkey::VARCHAR AS "Customer no.", c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN '  ' || c_mktsegment || chr(11) || ' <&> "_x0041_"' || chr(13) || chr(10) || 'naïve 😀' END AS remark FROM customer""")
def sheet_round_trip(spark, d):
    """Workbooks that the query writes, each with two lines above its header, read back as one table."""
    path = scratch_path(spark, "sheets")
    remark = F.concat(F.lit("  "), "c_mktsegment", F.lit('\x0b <&> "_x0041_"\r\nnaïve 😀'))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("Customer no."), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 7 != 0, remark).alias("remark"))
    sheets.write_sheet(rows.repartition(3, "`Customer no.`"), path, sheet="Customers & more", preface="a title\nand a note")
    return sheets.read_sheet(spark, path, sheet="Customers & more", skip_rows=2)


@query(f"WITH {HIERARCHY} SELECT endpoint, status, count(*) AS n FROM states GROUP BY ALL")
def status_partitions(spark, d):
    from .evidence import states

    path = scratch_path(spark, "states")
    sinks.write_by_status(states(spark, d).select("sequence", "endpoint", "status"), path)
    return spark.read.parquet(path).groupBy("endpoint", "status").agg(F.count("*").alias("n"))


@query(f"WITH {HIERARCHY} SELECT id, sequence, length(sequence) AS length FROM pivoted")
def card_jsonl_round_trip(spark, d):
    path = scratch_path(spark, "cards")
    b = built(spark, d)
    cards.write_jsonl(b, path)
    return spark.read.schema("id string, sequence string, length long").json(path)


@query(f"WITH {HIERARCHY} SELECT count(*) AS n_lines FROM pivoted")
def checksum_manifest(spark, d):
    """Files of an output have digests of 64 digits; the lines are those of the table."""
    path = scratch_path(spark, "manifest")
    sinks.write_jsonl(pivot(spark, d), path, compression="none")
    bad = sinks.checksums(spark, path).where("length(sha256) <> 64").count()
    return spark.read.text(path).agg((F.count("*") + F.lit(bad)).alias("n_lines"))


@query(f"WITH {RESOLVED} SELECT sequence, endpoint, source, source_status FROM resolved")
def streaming_source_states(spark, d):
    """The votes as a stream of files, in one run over all that is there."""
    import uuid

    path = scratch_path(spark, "votes")
    v = votes(spark, d).select("raw_sequence", "endpoint", "source", "label")
    v.write.parquet(path)
    stream = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 4).parquet(path)
    return streaming.run_once(spark, stream, f"states_{uuid.uuid4().hex}", scratch_path(spark, "stream"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return streaming.arrivals(table(spark, d, "events")).withColumns({"start": F.date_format("start", "yyyy-MM-dd HH:mm:ss"), "total": F.round("total", 4)})


@query(f"WITH {VOTES} SELECT DISTINCT 'sha256_' || sha256(sequence) AS id FROM norm WHERE sequence IS NOT NULL")
def id_sets(spark, d):
    return readers.id_set(votes(spark, d).select(normalize_sequence(F.col("raw_sequence")).alias("sequence")))


@query(f"WITH {VOTES} SELECT sequence, CASE WHEN label = 1 THEN 'Positive' ELSE 'Negative' END AS label, count(*) AS n FROM clean WHERE label IN (0, 1) GROUP BY ALL")
def labelled_sequences(spark, d):
    v = clean(spark, d)
    return readers.labelled_sequences(v.where("label = 1"), v.where("label = 0")).groupBy("sequence", "label").agg(F.count("*").alias("n"))
