"""Queries that write files from the tables, read them by the sources, and say what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import printed_sequence
from ..sources import files, records
from ..sources.views import EVENT_SQL, event_sequences, table
from .catalog import query
from .search import write_results
from .search_queries import EVENT_PAIRS, event_report


def _lines(rows: DataFrame, path: str, *order: str) -> str:
    """Write the column `line` as one text file, which all these formats are."""
    rows.coalesce(1).sortWithinPartitions(*order).select("line").write.text(path)
    return path


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's url, and an empty line after every third."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(F.when(F.col("page_id") % 3 == 0, F.array("url", F.lit(""))).otherwise(F.array("url"))).alias("line"))
    return rows


@query("SELECT url AS value FROM pages WHERE url <> ''")
def list_file(spark, sf_dir):
    return files.read_list(spark, _lines(_urls(spark, sf_dir), files.scratch(spark), "page_id"))


@query("SELECT string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10) AS value FROM region")
def whole_file(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("line"))
    path = _lines(rows, files.scratch(spark), "r_regionkey")
    return files.read_whole(spark, path).select("value")


@query("SELECT c_name || '|' || c_mktsegment || '|' || c_custkey AS fields FROM customer")
def delimited_file(spark, sf_dir):
    """Fields between either of two delimiters, of which empty ones vanish."""
    line = F.concat(F.col("c_name"), F.lit(";;"), F.col("c_mktsegment"), F.lit(",;"), F.col("c_custkey").cast("string"), F.lit(";"))
    path = _lines(table(spark, sf_dir, "customer").select("c_custkey", line.alias("line")), files.scratch(spark), "c_custkey")
    return files.read_fields(spark, path, ";,").select(F.array_join("fields", "|").alias("fields"))


@query("SELECT CAST(p_partkey AS INTEGER) AS character, CAST(p_partkey * 7 % 1009 AS INTEGER) AS mapdomain FROM part")
def alphabet_file(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.format_string('"%d",%d', "p_partkey", F.col("p_partkey") * 7 % 1009).alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("character,mapdomain").alias("line"))
    return files.read_alphabet(spark, _lines(head.unionByName(rows), files.scratch(spark), "p_partkey"))


def _recorded(spark, sf_dir):
    """The events' sequences as records, each with a url and the places of its letters as info."""
    info = F.transform("letters", lambda x, k: k * 2)
    return event_sequences(spark, sf_dir).select("seq_id", F.format_string("/db/u%04dA.seq", "seq_id").alias("url"), F.concat(F.lit("user "), F.col("seq_id").cast("string")).alias("description"), F.lit("events").alias("alphabet"), "letters", info.alias("info"))


@query(f"WITH {EVENT_SQL} SELECT row_number() OVER (ORDER BY seq_id DESC) - 1 AS seq_id, printf('u%04dA.seq', seq_id) AS code, 'user ' || seq_id AS description, array_to_string(letters, '-') AS letters, array_to_string(list_transform(range(0, len(letters)), lambda k: k * 2), '-') AS info, CAST(len(letters) AS INTEGER) AS length FROM ev")
def sequence_files(spark, sf_dir):
    """Binary records, a file each, read back in the order of a list."""
    path = files.scratch(spark)
    rows = _recorded(spark, sf_dir)
    files.write_records(rows, f"{path}/records").write.format("noop").mode("overwrite").save()
    names = _lines(rows.select("seq_id", F.col("url").alias("line")), f"{path}/list", F.desc("seq_id"))
    found = files.load_sequences(spark, names, f"{path}/records")
    return found.select("seq_id", F.substring_index("url", "/", -1).alias("code"), "description", F.array_join("letters", "-").alias("letters"), F.array_join("info", "-").alias("info"), "length")


_ATOMS = f"codes AS (SELECT {list(files.RESIDUES.values())} AS letters), atoms AS (SELECT p_partkey AS n, chr(CAST(65 + p_size % 4 AS INTEGER)) AS chain, CASE WHEN p_partkey % 31 = 30 THEN 'X' ELSE letters[p_partkey % 20 + 1] END AS r FROM part, codes WHERE p_partkey % 5 <> 4), chains AS (SELECT chain, string_agg(r, '' ORDER BY n) AS residues FROM atoms GROUP BY chain)"


def _coordinates(spark, sf_dir):
    """Parts as lines of coordinates: every fifth another atom, every 31st an unknown residue."""
    names = F.array(*map(F.lit, files.RESIDUES))
    residue = F.when(F.col("p_partkey") % 31 == 30, "UNK").otherwise(F.element_at(names, (F.col("p_partkey") % 20 + 1).cast("int")))
    atom = F.when(F.col("p_partkey") % 5 == 4, " CB ").otherwise(" CA ")
    line = F.format_string("ATOM  %5d %s %s %s%4d", F.col("p_partkey") % 100_000, atom, residue, F.char(65 + F.col("p_size") % 4), F.col("p_partkey") % 10_000)
    path = _lines(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), files.scratch(spark), "p_partkey")
    return files.read_places(spark, path)


@query(f"WITH {_ATOMS} SELECT chain, residues, CAST(length(residues) AS INTEGER) AS length FROM chains")
def residue_strings(spark, sf_dir):
    return files.chain_residues(_coordinates(spark, sf_dir))


@query(f"WITH {_ATOMS} SELECT '>p | chain ' || chain || ' | ' || length(residues) || ' aa' || chr(10) || array_to_string(list_transform(range(0, CAST(ceil(length(residues) / 60.0) AS BIGINT)), lambda k: substr(residues, k * 60 + 1, 60)), chr(10)) AS fasta, chain FROM chains")
def chain_fasta(spark, sf_dir):
    return files.chains_of_coordinates(_coordinates(spark, sf_dir), "p")


@query(f"WITH {_ATOMS} SELECT CAST(ascii(chain) - 65 AS BIGINT) AS seq_id, array_to_string(list_transform(string_split(residues, ''), lambda c: ascii(c)), '-') AS letters, '7-8-9' AS info, CAST(length(residues) AS INTEGER) AS length FROM chains")
def residue_sequences(spark, sf_dir):
    """Records whose letters are replaced by their chains' residues as char codes."""
    rows = spark.range(4).select(F.col("id").alias("seq_id"), F.concat(F.lit("/db/"), F.char(65 + F.col("id"))).alias("url"), F.lit("").alias("description"), F.lit("aa").alias("alphabet"), F.array(F.lit(7), F.lit(8), F.lit(9)).alias("letters"))
    found = files.with_residues(rows, files.chain_residues(_coordinates(spark, sf_dir)).withColumnRenamed("chain", "code"))
    return found.select("seq_id", F.array_join("letters", "-").alias("letters"), F.array_join("info", "-").alias("info"), "length")


@query("SELECT 'q' || p_partkey AS a, 't' || p_size AS b, p_size / 100 AS tm FROM part")
def result_edges(spark, sf_dir):
    """Edges out of tagged result lines among other lines."""
    line = F.format_string("CSV;[--*];/db/q%d;t%d;%s;0.1;3", "p_partkey", "p_size", (F.col("p_size") / 100).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(F.lit("noise;a;b;c;1.0"), line)).alias("line"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("CSV;picture;sequence a;sequence b;tm_score").alias("line"))
    return files.edges_of_results(_lines(head.unionByName(rows), files.scratch(spark), "p_partkey"), spark)


_PLAIN = "k AS (SELECT c_custkey AS c, printf('%04d', c_custkey % 10000) || 'A' AS q FROM customer)"


def _plain_report(spark, sf_dir):
    """Customers as queries of a plain-text report: two targets each, the second without a score for every fourth."""
    c = F.col("c_custkey")
    target = lambda shift, tail: F.format_string(f"12  /db/%04d{tail} ", (c + shift) % 10_000)
    lines = [F.format_string("/db/%04dA", c % 10_000), target(1, "A"), F.lit("rmsd: 2.25, tm_scr 0.99"), F.format_string("tm_scr 0.%d", 100 + c % 800), F.lit("1-exp(-HSS)"), target(F.when(c % 3 == 0, 0).otherwise(2), "A"), F.when(c % 4 == 0, "nothing").otherwise("tm_scr 0.75"), F.lit("1-exp(-HSS)")]
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(F.array(*lines)).alias("k", "line"))
    path = files.scratch(spark)  # several files, in the order of customers, of which none is cut
    rows.repartitionByRange("c_custkey").sortWithinPartitions("c_custkey", "k").select("line").write.text(path)
    return files.read_places(spark, path)


@query(f"WITH {_PLAIN} SELECT q AS a, printf('%04d', (c + 1) % 10000) || 'A' AS b, CAST('0.' || (100 + c % 800) AS DOUBLE) AS tm FROM k UNION ALL SELECT q, printf('%04d', (c + 2) % 10000) || 'A', CASE WHEN c % 4 = 0 THEN CAST('0.' || (100 + c % 800) AS DOUBLE) ELSE 0.75 END FROM k WHERE c % 3 <> 0")
def plain_report_edges(spark, sf_dir):
    return files.edges_of_report(_plain_report(spark, sf_dir)).drop("n")


@query(f"WITH {_PLAIN} SELECT CAST(row_number() OVER (ORDER BY c) AS INTEGER) AS label, q AS code FROM k")
def plain_report_labels(spark, sf_dir):
    return files.labels_of_report(_plain_report(spark, sf_dir))


@query("SELECT CAST(k AS INTEGER) AS i, round(sum(embedding[k + 1]::DOUBLE), 4) AS total, count(*) AS n FROM (SELECT embedding, unnest(range(0, 64)) AS k FROM embeddings) GROUP BY k")
def series_file(spark, sf_dir):
    path = files.scratch(spark)
    files.write_series(table(spark, sf_dir, "embeddings"), "embedding", path)
    rows = spark.read.csv(path, sep="\t", schema="i int, value double")
    return rows.groupBy("i").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query(
    EVENT_PAIRS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY swscore DESC, n_seeds DESC, target_id) AS rank FROM pairs JOIN sw USING (query_id, target_id)) "
    "SELECT row_number() OVER (ORDER BY query_id, rank) AS place, 22 AS fields, CAST(query_id AS VARCHAR) AS sequence_a, CAST(target_id AS VARCHAR) AS sequence_b, CAST(n_seeds AS VARCHAR) AS matches, printf('%.6f', CAST(swscore AS DOUBLE)) AS swscore FROM ranked "
    "UNION ALL SELECT 0, 22, 'sequence a', 'sequence b', 'matches', 'matches_swscore'"
)
def result_file(spark, sf_dir):
    """A written report's lines in the order in which they stand in its files: the header, then by query and rank."""
    path = files.scratch(spark)
    write_results(event_report(spark, sf_dir, ranked=True), path, "gzip")
    lines = files.read_places(spark, path)
    before = lines.groupBy("path").agg(F.count("*").alias("lines")).withColumn("before", F.sum("lines").over(Window.orderBy("path")) - F.col("lines"))  # a row a file
    parts = F.split("value", ";", -1)
    return lines.join(F.broadcast(before), "path").select((F.col("before") + F.col("n")).alias("place"), F.size(parts).alias("fields"), parts[2].alias("sequence_a"), parts[3].alias("sequence_b"), parts[6].alias("matches"), parts[8].alias("swscore"))


@query(f"WITH {EVENT_SQL} SELECT row_number() OVER (ORDER BY printf('u%04dA.seq', seq_id)) - 1 AS seq_id, printf('/db/u%04dA.seq', seq_id) AS url, array_to_string(letters, '-') AS letters, CAST(len(letters) AS INTEGER) AS length FROM ev")
def record_source(spark, sf_dir):
    """The events' sequences written and read as the format "seq", without the columns that nobody asks for."""
    records.register(spark)
    path = files.scratch(spark)
    _recorded(spark, sf_dir).write.format("seq").mode("append").save(path)
    read = spark.read.format("seq").schema("seq_id long, url string, letters array<int>, length int").load(path)
    return read.select("seq_id", "url", F.array_join("letters", "-").alias("letters"), "length")


@query("SELECT url AS value FROM pages")
def exported_file(spark, sf_dir):
    path = files.scratch(spark)
    rows = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("line"))
    _lines(rows, f"{path}/result", "page_id")
    if not files.export(spark, {f"{path}/result": f"{path}/copy"}):
        raise FileNotFoundError(path)
    return spark.read.text(f"{path}/copy")


@query(
    f"WITH {EVENT_SQL}, w AS (SELECT *, printf('/db/u%04dA.seq', seq_id) AS url, list_transform(letters, lambda x: CAST(x AS VARCHAR)) AS t FROM ev), "
    "rows AS (SELECT seq_id, url, t, k * 26 AS place FROM w, range(0, 100000) r(k) WHERE k * 26 < len(t)) "
    "SELECT seq_id, '>' || url || chr(10) || '>events' || chr(10) || string_agg(chr(10) || lpad(CAST(place AS VARCHAR), 5, ' ') || chr(9) || array_to_string(list_transform(t[place + 1:place + 26], lambda x: lpad(x, 2, ' ')), ''), '' ORDER BY place) AS page FROM rows GROUP BY seq_id, url"
)
def print_sequence(spark, sf_dir):
    return _recorded(spark, sf_dir).select("seq_id", printed_sequence(F.col("url"), F.col("alphabet"), F.col("letters")).alias("page"))
