"""Queries on encodings, text, numbers, sorting and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import codes, numbers, text
from ..operators.align import gapped_global, gapped_local, unit_edits, weighted_edits
from ..operators.skip import find_all
from ..operators.suffixes import kept, last_before, numbered
from ..operators.ties import close_ranks
from ..progress import required
from ..sources.views import EVENT_SQL, PROB_SQL, event_sequences, probability_vectors, table
from .catalog import query

_CANTOR = "((({a}) + ({b})) * (({a}) + ({b}) + 1)) // 2 + ({b})"


def _pair(a: str, b: str) -> str:
    return _CANTOR.format(a=a, b=b)


_TWO = f"""{PROB_SQL}, r AS (SELECT seq_id, pos, c, probs[c] AS p, row_number() OVER (PARTITION BY pos ORDER BY probs[c] DESC, c) AS n FROM (SELECT *, unnest(range(1, 65)) AS c FROM pv)),
two AS (SELECT x.seq_id, x.pos, x.c AS first, CASE WHEN y.p > 1e-4 THEN y.c ELSE x.c END AS second FROM r x JOIN r y USING (pos) WHERE x.n = 1 AND y.n = 2),
coded AS (SELECT *, {_pair('first', 'second')} AS code, {_pair('first', 'first')} AS own FROM two),
alphabet AS (SELECT row_number() OVER (ORDER BY mapdomain) - 1 AS character, mapdomain FROM (
  SELECT {_pair('c', 'c')} AS mapdomain FROM range(1, 65) t(c) UNION SELECT code FROM coded WHERE first <> second GROUP BY code HAVING count(*) > 1)),
letters AS (SELECT coded.seq_id, coded.pos, first, second, CAST(coalesce(a.character, b.character) AS INTEGER) AS letter, CAST(CASE WHEN a.character IS NULL THEN second ELSE 0 END AS INTEGER) AS info
  FROM coded LEFT JOIN alphabet a ON a.mapdomain = code LEFT JOIN alphabet b ON b.mapdomain = own)"""


#: Classes of the test tables' vectors.
CLASSES = 64


def _encoded(spark, sf_dir):
    vectors = probability_vectors(spark, sf_dir)
    return codes.quantise(vectors, codes.make_alphabet(vectors))


def _sums_of_letters(spark, sf_dir):
    """(letter, members, sums): the vectors of each letter added up class by class, one row a letter, CLASSES ** 2 of them at most."""
    sums = F.array(*(F.sum(F.get("probs", F.lit(c))) for c in range(CLASSES)))
    return _encoded(spark, sf_dir).groupBy(F.col("letter").cast("int").alias("letter")).agg(F.count("*").alias("members"), sums.alias("sums"))


@query(f"SELECT p_partkey, {_pair('p_partkey', 'p_size')} AS code FROM part")
def cantor_pair(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", codes.pair(F.col("p_partkey"), F.col("p_size")).alias("code"))


@query("SELECT p_partkey, p_partkey AS i, CAST(p_size AS BIGINT) AS j FROM part")
def cantor_decode(spark, sf_dir):
    z = codes.unpair(codes.pair(F.col("p_partkey"), F.col("p_size")))
    return table(spark, sf_dir, "part").select("p_partkey", z["i"].alias("i"), z["j"].alias("j"))


@query(f"SELECT event_id, {_pair('length(event_type)', _pair('event_id % 7', 'user_id % 5'))} AS code FROM events")
def cantor_vector(spark, sf_dir):
    values = F.array(F.length("event_type").cast("long"), F.col("event_id") % 7, F.col("user_id") % 5)
    return table(spark, sf_dir, "events").select("event_id", codes.fold(values).alias("code"))


@query("SELECT event_id, CAST(length(event_type) AS BIGINT) AS a, event_id % 7 AS b, user_id % 5 AS c FROM events")
def cantor_decode_vector(spark, sf_dir):
    values = F.array(F.length("event_type").cast("long"), F.col("event_id") % 7, F.col("user_id") % 5)
    back = codes.unfold(codes.fold(values), 3)
    return table(spark, sf_dir, "events").select("event_id", *(back[k].alias(c) for k, c in enumerate("abc")))


@query("SELECT o_orderkey, CAST(w * (w + 1) // 2 + j AS BIGINT) AS code, CAST(w - j AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM (SELECT o_orderkey, CAST(2000000003 AS HUGEINT) + o_orderkey + o_custkey AS w, CAST(1000000001 AS HUGEINT) + o_custkey AS j FROM orders)")
def cantor_large(spark, sf_dir):
    """Pairs whose numbers are beyond what a double holds exactly, there and back."""
    code = codes.pair(1_000_000_002 + F.col("o_orderkey"), 1_000_000_001 + F.col("o_custkey"))
    back = codes.unpair(F.col("code"))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).select("o_orderkey", "code", back["i"].alias("i"), back["j"].alias("j"))


@query(f"WITH {_TWO} SELECT character, mapdomain FROM alphabet")
def make_alphabet(spark, sf_dir):
    return codes.make_alphabet(probability_vectors(spark, sf_dir)).select(F.col("character").cast("long").alias("character"), "mapdomain")


@query(f"WITH {_TWO}, q AS (SELECT p_partkey, {_pair('1 + p_partkey % 64', '1 + p_partkey % 64')} + p_partkey % 2 AS code FROM part) SELECT p_partkey, CAST(coalesce(character, (SELECT count(*) FROM alphabet) + 1) AS BIGINT) AS place FROM q LEFT JOIN alphabet ON mapdomain = code")
def alphabet_lookup(spark, sf_dir):
    """The place of each code in the alphabet, its size and one more if it has none."""
    alphabet = codes.make_alphabet(probability_vectors(spark, sf_dir))
    c = 1 + F.col("p_partkey") % 64
    asked = table(spark, sf_dir, "part").select("p_partkey", (codes.pair(c, c) + F.col("p_partkey") % 2).alias("mapdomain"))
    size = alphabet.agg(F.count("*").alias("n"))
    found = asked.join(alphabet, "mapdomain", "left").crossJoin(F.broadcast(size))
    return found.select("p_partkey", F.coalesce(F.col("character"), F.col("n") + 1).cast("long").alias("place"))


@query(f"WITH {_TWO} SELECT pos, CAST(first AS INTEGER) AS first, CAST(second AS INTEGER) AS second FROM two")
def quantise_top2(spark, sf_dir):
    t = codes.top_two(F.col("probs"))
    return probability_vectors(spark, sf_dir).select("pos", t["first"].alias("first"), t["second"].alias("second"))


def _joined(rows):
    return rows.select("seq_id", F.array_join("letters", "-").alias("letters"), F.array_join("info", "-").alias("info"))


@query(f"WITH {_TWO} SELECT seq_id, string_agg(CAST(letter AS VARCHAR), '-' ORDER BY pos) AS letters, string_agg(CAST(info AS VARCHAR), '-' ORDER BY pos) AS info FROM letters GROUP BY seq_id")
def encode_sequence(spark, sf_dir):
    vectors = probability_vectors(spark, sf_dir)
    return _joined(codes.encoded(vectors, codes.make_alphabet(vectors)))


@query(f"WITH {_TWO} SELECT seq_id, string_agg(CAST(letter AS VARCHAR), '-' ORDER BY pos) AS letters, string_agg(CAST(info AS VARCHAR), '-' ORDER BY pos) AS info FROM (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) - 1 AS place FROM letters) WHERE place >= 3 AND place < 11 GROUP BY seq_id")
def encode_range(spark, sf_dir):
    """Places 3 to 10 of each sequence alone."""
    vectors = probability_vectors(spark, sf_dir)
    return _joined(codes.encoded(vectors, codes.make_alphabet(vectors), 3, 11))


@query(f"WITH {_TWO} SELECT letter, CAST(c AS INTEGER) AS class, round(sum(probs[c]), 6) AS total, count(*) AS members FROM (SELECT letter, probs, unnest(range(1, 65)) AS c FROM letters JOIN pv USING (pos)) GROUP BY ALL")
def avg_prob_vector(spark, sf_dir):
    sums = _sums_of_letters(spark, sf_dir).select("letter", "members", F.posexplode("sums").alias("c", "total"))
    return sums.select("letter", (F.col("c") + 1).alias("class"), F.round("total", 6).alias("total"), "members")


@query(f"WITH {_TWO}, v AS (SELECT letter, c, sum(probs[c]) AS x FROM (SELECT letter, probs, unnest(range(1, 65)) AS c FROM letters JOIN pv USING (pos)) GROUP BY ALL), d AS (SELECT a.letter AS i, b.letter AS j, sum(a.x * b.x) AS dot FROM v a JOIN v b USING (c) GROUP BY ALL) SELECT i, j, round(dot, 5) AS dot, round(sum(dot) OVER (PARTITION BY i), 5) AS row_sum FROM d")
def letter_dot_matrix(spark, sf_dir):
    sums = kept(_sums_of_letters(spark, sf_dir))  # both sides of the pairs
    other = sums.select(F.col("letter").alias("j"), F.col("sums").alias("other"))
    dot = F.aggregate(F.zip_with("sums", "other", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    rows = sums.select(F.col("letter").alias("i"), "sums").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "i")  # few rows, but much to do for each
    dots = rows.crossJoin(F.broadcast(other)).select("i", "j", dot.alias("dot"))  # all pairs of an alphabet's letters are the result
    return dots.select("i", "j", F.round("dot", 5).alias("dot"), F.round(F.sum("dot").over(Window.partitionBy("i")), 5).alias("row_sum"))


@query("SELECT i, j, round(CASE WHEN i = j THEN score ELSE m * score END, 6) AS value FROM (SELECT a.r_regionkey AS i, b.r_regionkey AS j, a.r_regionkey + 0.5 AS score, length(a.r_name) + length(b.r_name) AS m FROM region a CROSS JOIN region b)")
def scaled_matrix(spark, sf_dir):
    """A letter matrix with rows scaled by scores, which also are its diagonal."""
    r = table(spark, sf_dir, "region")
    a = r.select(F.col("r_regionkey").alias("i"), F.length("r_name").alias("x"), (F.col("r_regionkey") + 0.5).alias("score"))
    b = r.select(F.col("r_regionkey").alias("j"), F.length("r_name").alias("y"))
    value = F.when(F.col("i") == F.col("j"), F.col("score")).otherwise((F.col("x") + F.col("y")) * F.col("score"))
    return a.crossJoin(F.broadcast(b)).select("i", "j", F.round(value, 6).alias("value"))


@query(
    "SELECT doc_id, CAST(c * 500 + p - 1 AS INTEGER) AS pos FROM (SELECT doc_id, c, piece, unnest(range(1, CAST(least(500, length(piece) - 2) AS BIGINT) + 1)) AS p FROM ("
    "SELECT doc_id, c, substr(text, c * 500 + 1, 502) AS piece FROM (SELECT doc_id, text, unnest(range(0, CAST(length(text) // 500 + 1 AS BIGINT))) AS c FROM documents))) WHERE substr(piece, p, 3) = 'ene'"
)
def text_occurrences(spark, sf_dir):
    """A pattern that overlaps itself, in whole documents."""
    return find_all(table(spark, sf_dir, "documents"), "text", "ene", "doc_id")


@query(f"WITH {EVENT_SQL} SELECT seq_id, CAST(p AS INTEGER) AS pos FROM (SELECT seq_id, letters, unnest(range(0, len(letters) - 1)) AS p FROM ev) WHERE letters[p + 1] = letters[p + 2] AND letters[p + 1] = 2")
def array_occurrences(spark, sf_dir):
    """The same of letter arrays: two letters 2 after each other, overlapping ones too."""
    return find_all(event_sequences(spark, sf_dir), "letters", [2, 2], "seq_id")


@query(
    "WITH p AS (SELECT DISTINCT p_name AS p, CAST(length(p_name) AS BIGINT) AS n FROM part), jk AS (SELECT p, n, j, unnest(range(1, n + 1)) AS k FROM (SELECT p, n, unnest(range(0, n + 1)) AS j FROM p)), "
    "ok AS (SELECT p, j, k FROM jk WHERE (n - greatest(j, k) <= 0 OR substr(p, greatest(j, k) + 1, n - greatest(j, k)) = substr(p, greatest(j, k) - k + 1, n - greatest(j, k))) AND (j = 0 OR k >= j OR substr(p, j - k, 1) <> substr(p, j, 1))) "
    "SELECT p AS pattern, string_agg(CAST(k AS VARCHAR), ',' ORDER BY j) AS shifts FROM (SELECT p, j, min(k) AS k FROM ok GROUP BY p, j) GROUP BY p"
)
def good_suffix_table(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("pattern")).distinct()
    return names.select("pattern", F.array_join(text.good_suffix(F.col("pattern")), ",").alias("shifts"))


@query("SELECT page_id, ch, CAST(max(p) - 1 AS INTEGER) AS last FROM (SELECT page_id, p, substr(url, p, 1) AS ch FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS p FROM pages)) GROUP BY ALL")
def bad_char_table(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split("url", "")).alias("p", "ch")).filter("ch <> ''")
    return rows.groupBy("page_id", "ch").agg(F.max("p").alias("last"))


@query("SELECT p_partkey, CAST(ascii(p_name) AS INTEGER) AS code FROM part")
def ascii_code(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.ascii("p_name").alias("code"))


@query("SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part")
def edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", unit_edits(F.col("p_name"), F.col("p_type")).alias("distance"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, split_part(url, '/', -1) AS base, url || '.seq' AS extended, '/data/' || split_part(url, '/', -1) AS attached FROM pages")
def path_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.dir_name(url).alias("dir"), text.base_name(url).alias("base"), text.attach_extension(url, "seq").alias("extended"), text.attach_path("/data", text.base_name(url)).alias("attached"))


@query("SELECT page_id, array_to_string(list_filter(regexp_split_to_array(url, '[:/.?=&]+'), lambda x: x <> ''), '|') AS tokens FROM pages")
def tokenise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.tokens(F.col("url"), ":/.?=&"), "|").alias("tokens"))


@query("SELECT event_id, trim('''\"' || props || '\"''', '''\"') AS trimmed FROM events")
def trim_quote(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.trim_quotes(F.concat(F.lit("'\""), "props", F.lit("\"'"))).alias("trimmed"))


@query("SELECT doc_id, md5(trim(chr(9) || ' ' || text || chr(10) || ' ', ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS trimmed FROM documents")
def trim_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.trim_blanks(F.concat(F.lit("\t "), "text", F.lit("\n ")))).alias("trimmed"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE c_name || '-' || c_mktsegment END AS joined FROM customer")
def concat_delim(spark, sf_dir):
    a = F.when(F.col("c_custkey") % 3 == 1, F.lit(None)).otherwise(F.col("c_name"))
    b = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.concat_delimited(a, b, "-").alias("joined"))


@query("SELECT p_partkey, reverse(p_name) AS reversed FROM part")
def reverse_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.reverse("p_name").alias("reversed"))


@query("SELECT o_orderkey, lower(printf('%x', o_orderkey)) AS hexadecimal, bin(o_orderkey) AS binary FROM orders")
def itoa(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", text.to_radix(key, 16).alias("hexadecimal"), text.to_radix(key, 2).alias("binary"))


@query(f"WITH {EVENT_SQL} SELECT seq_id, array_to_string(letters, '-') AS dump FROM ev")
def dump_letters(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("seq_id", F.array_join("letters", "-").alias("dump"))


@query("SELECT vec_id, i, chr(9) AS tab, CAST(i AS VARCHAR) || chr(9) || printf('%.6f', embedding[i + 1]::DOUBLE) AS line FROM (SELECT vec_id, embedding, CAST(unnest(range(0, 64)) AS INTEGER) AS i FROM embeddings)")
def dump_series(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "i", F.lit("\t").alias("tab"), F.concat(F.col("i").cast("string"), F.lit("\t"), text.six_decimals(F.col("x"))).alias("line"))


@query(
    "WITH v AS (SELECT o_custkey, list(CAST(floor(o_totalprice) AS BIGINT) ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey), w AS (SELECT c_custkey, [CAST(floor(c_acctbal) AS BIGINT), 5000, 100000] AS y FROM customer), "
    "pairs AS (SELECT c_custkey, l, k, abs(x[l + 1] - y[k + 1]) AS d FROM (SELECT c_custkey, x, y, l, unnest(range(0, 3)) AS k FROM (SELECT c_custkey, x, y, unnest(range(0, len(x))) AS l FROM w JOIN v ON c_custkey = o_custkey))), "
    "best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY d, k, l) = 1) "
    "SELECT c_custkey, coalesce(d, 0) AS distance, CAST(l AS INTEGER) AS which FROM w LEFT JOIN best USING (c_custkey)"
)
def min_vec_dist(spark, sf_dir):
    """The least distance between a customer's prices and three amounts, and the place of the price that has it."""
    prices = F.sort_array(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").alias("v"))))
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(prices.getField("v").alias("x"))
    y = F.array(F.floor("c_acctbal"), F.lit(5000).cast("long"), F.lit(100_000).cast("long"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", y.alias("y")).join(x, "c_custkey", "left")
    found = rows.select("c_custkey", numbers.nearest_distance(F.col("x"), F.col("y")).alias("m"))
    return found.select("c_custkey", "m.distance", "m.which")


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 5) AS variance, round(stddev_pop(l_quantity), 6) AS deviation, round(stddev_samp(l_quantity), 6) AS sample_deviation FROM lineitem GROUP BY ALL")
def stats_mean_var_std(spark, sf_dir):
    q = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(q), 6).alias("mean"), F.round(F.var_pop(q), 5).alias("variance"), F.round(F.stddev_pop(q), 6).alias("deviation"), F.round(F.stddev_samp(q), 6).alias("sample_deviation"))


@query("WITH m AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, round(sum(l_discount * (l_quantity - m) ** 2) / count(*), 4) AS variance FROM lineitem JOIN m USING (l_returnflag) GROUP BY ALL")
def weighted_var(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    means = rows.groupBy("l_returnflag").agg(F.avg("l_quantity").alias("m"))
    return rows.join(F.broadcast(means), "l_returnflag").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_discount") * (F.col("l_quantity") - F.col("m")) ** 2) / F.count("*"), 4).alias("variance"))


@query("SELECT l_linestatus, round(covar_samp(l_quantity, l_discount), 6) AS covariance, round(var_samp(l_quantity), 5) AS vx, round(var_samp(l_discount), 6) AS vy, round(corr(l_quantity, l_discount), 6) AS rho FROM lineitem GROUP BY ALL")
def cov_rho(spark, sf_dir):
    x, y = "l_quantity", "l_discount"
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.covar_samp(x, y), 6).alias("covariance"), F.round(F.var_samp(x), 5).alias("vx"), F.round(F.var_samp(y), 6).alias("vy"), F.round(F.corr(x, y), 6).alias("rho"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS dot, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS argmax FROM embeddings")
def dot_argmax(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.dot(F.col("embedding"), F.col("embedding")), 5).alias("dot"), numbers.argmax(F.col("embedding")).alias("argmax"))


_BI = "(c_acctbal / 1000) AS x, (c_custkey % 10 / 2) AS y"


@query(f"WITH b AS (SELECT c_custkey, {_BI} FROM customer), z AS (SELECT c_custkey, (x - 4) / 3 AS u, (y - 2) / 2 AS v FROM b) SELECT c_custkey, round(exp(-(u * u - 2 * 0.3 * u * v + v * v) / (2 * (1 - 0.09))) / (2 * pi() * 3 * 2 * sqrt(1 - 0.09)), 7) AS density FROM z")
def bivar_norm(spark, sf_dir):
    n = [F.lit(v) for v in (4.0, 2.0, 3.0, 2.0, 0.3)]
    d = numbers.bivariate_normal(F.col("c_acctbal") / 1000, F.col("c_custkey") % 10 / 2, *n)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(d, 7).alias("density"))


@query(f"WITH b AS (SELECT c_custkey, {_BI} FROM customer), z AS (SELECT c_custkey, (y - (2 + 0.3 * 2 / 3 * (x - 4))) / (2 * sqrt(1 - 0.09)) AS z FROM b) SELECT c_custkey, round(exp(-z * z / 2) / (2 * sqrt(1 - 0.09) * sqrt(2 * pi())), 7) AS density FROM z")
def bivar_cond(spark, sf_dir):
    n = [F.lit(v) for v in (4.0, 2.0, 3.0, 2.0, 0.3)]
    d = numbers.conditional_normal(F.col("c_acctbal") / 1000, F.col("c_custkey") % 10 / 2, *n)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(d, 7).alias("density"))


@query("SELECT p_partkey, round(p_size ** 4 / 4.0 + p_size, 4) AS area FROM part")
def simpson_1d(spark, sf_dir):
    area = numbers.simpson(lambda x: x * x * x + 1, F.lit(0.0), F.col("p_size").cast("double"), 5)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(area, 4).alias("area"))


@query("SELECT r_regionkey, round((r_regionkey + 1) ** 3 / 3.0 * 2 + (r_regionkey + 1) * 2, 6) AS volume FROM region")
def simpson_2d(spark, sf_dir):
    volume = numbers.simpson2d(lambda x, y: x * x + y, F.lit(0.0), F.col("r_regionkey") + 1.0, F.lit(0.0), F.lit(2.0), 3)
    return table(spark, sf_dir, "region").select("r_regionkey", F.round(volume, 6).alias("volume"))


_CELLS = "m AS (SELECT label AS i, CAST(k AS INTEGER) AS j, sum(embedding[k + 1]::DOUBLE) AS v FROM (SELECT label, embedding, unnest(range(0, 64)) AS k FROM embeddings) GROUP BY ALL)"


def _matrix(spark, sf_dir):
    """Sums of embeddings as cells (i, j, v) of a matrix of labels by places."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return rows.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))


@query(f"WITH {_CELLS} SELECT j AS i, i AS j, round(v, 4) AS v FROM m")
def transpose(spark, sf_dir):
    return _matrix(spark, sf_dir).select(F.col("j").alias("i"), F.col("i").alias("j"), F.round("v", 4).alias("v"))


@query(f"WITH {_CELLS} SELECT CASE WHEN i > 2 THEN i - 1 ELSE i END AS i, CASE WHEN j > 5 THEN j - 1 ELSE j END AS j, round(v, 4) AS v FROM m WHERE i <> 2 AND j <> 5")
def row_col_delete(spark, sf_dir):
    """The minor without row 2 and column 5."""
    rows = _matrix(spark, sf_dir).filter("i <> 2 and j <> 5")
    down = lambda c, k: F.when(F.col(c) > k, F.col(c) - 1).otherwise(F.col(c)).alias(c)
    return rows.select(down("i", 2), down("j", 5), F.round("v", 4).alias("v"))


@query(f"WITH {_CELLS} SELECT a.i, a.j, round(a.v + b.v, 4) AS v FROM m a JOIN m b ON a.i = b.i AND a.j = 63 - b.j")
def matrix_add(spark, sf_dir):
    m = _matrix(spark, sf_dir)
    turned = m.select("i", (63 - F.col("j")).alias("j"), F.col("v").alias("w"))
    return m.join(turned, ["i", "j"]).select("i", "j", F.round(F.col("v") + F.col("w"), 4).alias("v"))


@query("SELECT a.r_regionkey AS i, b.n_nationkey AS j, CAST(a.r_regionkey * b.n_nationkey AS INTEGER) AS v FROM region a CROSS JOIN nation b")
def outer_product(spark, sf_dir):
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("i"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("j"))
    return b.crossJoin(F.broadcast(a)).select("i", "j", (F.col("i") * F.col("j")).alias("v"))


@query("SELECT o_orderkey, gcd(o_orderkey, o_custkey) AS divisor FROM orders")
def gcd(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.gcd(F.col("o_orderkey"), F.col("o_custkey")).alias("divisor"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 AND p_partkey % 3 - 1 < 0 THEN 1e200 ELSE round((p_size % 5)::DOUBLE ** (p_partkey % 3 - 1), 6) END AS value FROM part")
def power(spark, sf_dir):
    value = numbers.power((F.col("p_size") % 5).cast("double"), F.col("p_partkey") % 3 - 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(value == 1e200, value).otherwise(F.round(value, 6)).alias("value"))


@query("SELECT n_nationkey, CAST(factorial(CAST(n_nationkey % 13 AS INTEGER)) AS BIGINT) AS product, round(exp(n_nationkey / 100) - 1, 6) AS growth FROM nation")
def factorial_expm1(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.factorial(F.col("n_nationkey") % 13).alias("product"), F.round(F.expm1(F.col("n_nationkey") / 100), 6).alias("growth"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (a <= y AND x <= b) AS overlap, (a >= x AND b <= y) AS closed, (a > x AND b < y) AS open FROM (SELECT *, l_quantity AS a, l_quantity + 10 AS b, l_linenumber * 5 AS x, l_linenumber * 5 + 20 AS y FROM lineitem)")
def interval_predicates(spark, sf_dir):
    a, b, x, y = F.col("l_quantity"), F.col("l_quantity") + 10, F.col("l_linenumber") * 5, F.col("l_linenumber") * 5 + 20
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.overlaps(a, b, x, y).alias("overlap"), numbers.within_closed(a, b, x, y).alias("closed"), numbers.within_open(a, b, x, y).alias("open"))


@query("SELECT c_custkey, least(c_acctbal, 1000.0, c_custkey) AS low, greatest(c_acctbal, 1000.0, c_custkey) AS high, abs(c_acctbal) AS size FROM customer")
def min_max_abs(spark, sf_dir):
    values = (F.col("c_acctbal"), F.lit(1000.0), F.col("c_custkey").cast("double"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.least(*values).alias("low"), F.greatest(*values).alias("high"), F.abs("c_acctbal").alias("size"))


@query("SELECT label, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY embedding[1], vec_id) AS permutation FROM embeddings GROUP BY label")
def sort_permutation(spark, sf_dir):
    rows = F.sort_array(F.collect_list(F.struct(F.col("embedding")[0].alias("k"), "vec_id")))
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.array_join(rows["vec_id"], ",").alias("permutation"))


@query(f"WITH {EVENT_SQL} SELECT seq_id, row_number() OVER (ORDER BY letters, seq_id) - 1 AS rank FROM ev")
def multikey_sort(spark, sf_dir):
    return numbered(event_sequences(spark, sf_dir), "rank", "letters", "seq_id").select("seq_id", "rank")


@query("SELECT event_id, (SELECT max(o_orderkey) FROM orders WHERE o_orderkey <= event_id) AS lower FROM events")
def nearest_lower(spark, sf_dir):
    """As-of lookup of each event's number among the orders'."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("v"), F.col("o_orderkey").alias("lower"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("v"), "event_id")
    return last_before(keys, asked, "lower").select("event_id", "lower")


_SIGNED = "CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END::BIGINT"
_WRAP = "18446744073709551616::HUGEINT"
_LETTERS = "list_transform(letters, lambda x: CAST(x AS HUGEINT))"


@query(f"WITH {EVENT_SQL}, x AS (SELECT seq_id, list_reduce(list_prepend(CAST(len(letters) AS HUGEINT), {_LETTERS}), lambda h, x: xor(xor((h * 32) % {_WRAP}, h // 134217728), x)) AS h FROM ev) SELECT seq_id, {_SIGNED} AS hash FROM x")
def hash_knuth(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("seq_id", numbers.shift_xor_hash(F.col("letters")).alias("hash"))


_STEP = f"lambda h, x: xor(((h + x) * 1025) % {_WRAP}, (((h + x) * 1025) % {_WRAP}) // 64)"


@query(f"WITH {EVENT_SQL}, x AS (SELECT seq_id, (list_reduce(list_prepend(0::HUGEINT, {_LETTERS}), {_STEP}) * 9) % {_WRAP} AS a FROM ev), y AS (SELECT seq_id, (xor(a, a // 2048) * 32769) % {_WRAP} AS h FROM x) SELECT seq_id, {_SIGNED} AS hash FROM y")
def hash_jenkins(spark, sf_dir):
    return event_sequences(spark, sf_dir).select("seq_id", numbers.one_at_a_time_hash(F.col("letters")).alias("hash"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(e[1] * (e[5] * e[9] - e[6] * e[8]) - e[2] * (e[4] * e[9] - e[6] * e[7]) + e[3] * (e[4] * e[8] - e[5] * e[7]), 6) AS det FROM e")
def determinant(spark, sf_dir):
    """Of each vector's first nine numbers as a matrix of 3 rows."""
    cells = F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.determinant(cells), 6).alias("det"))


@query(
    "WITH RECURSIVE e AS (SELECT vec_id, list_transform(range(0, 8), lambda i: list_transform(embedding[8 * i + 1:8 * i + 8], lambda x: x::DOUBLE)) AS m, 1.0::DOUBLE AS det, 0 AS k FROM embeddings UNION ALL "
    "SELECT vec_id, list_transform(m[2:], lambda r: list_transform(range(2, len(r) + 1), lambda j: r[j] - r[1] / m[1][1] * m[1][j])), det * m[1][1], k + 1 FROM e WHERE k < 8) "
    "SELECT vec_id, round(det, 6) AS det FROM e WHERE k = 8"
)
def determinant_large(spark, sf_dir):
    """Of each vector's 64 numbers as a matrix of 8 rows."""
    cells = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.determinant(cells), 6).alias("det"))


@query(
    "WITH v AS (SELECT p_partkey, [p_size % 3, p_size % 5, p_size % 7] AS v FROM part), "
    "o AS (SELECT p_partkey, v, unnest([[v[1], v[2], v[3]], [v[1], v[3], v[2]], [v[2], v[1], v[3]], [v[2], v[3], v[1]], [v[3], v[1], v[2]], [v[3], v[2], v[1]]]) AS w FROM v), "
    "n AS (SELECT p_partkey, min(w) AS least, min(w) FILTER (WHERE w > v) AS next FROM o GROUP BY p_partkey) "
    "SELECT p_partkey, array_to_string(coalesce(next, least), ',') AS next FROM n"
)
def permutation_next(spark, sf_dir):
    values = F.array(*((F.col("p_size") % k).cast("int") for k in (3, 5, 7)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(numbers.next_permutation(values), ",").alias("next"))


_ROW = "list_transform(range(0, {n} + 1), lambda j: {x})"
#: Alignments of two names by their tables' rows, each from the one before it; {{c}} is the pair's j-th letter score.
_NAMES = "names AS (SELECT p_partkey, string_split(p_name, '') AS a, string_split(p_type, '') AS b, length(p_name) AS m, CAST(length(p_type) AS BIGINT) AS n FROM part)"


@query(
    f"WITH RECURSIVE {_NAMES}, t AS (SELECT p_partkey, 0 AS i, {_ROW.format(n='n', x='CAST(j * 2 AS BIGINT)')} AS r FROM names UNION ALL "
    "SELECT p_partkey, i, list_transform(range(0, n + 1), lambda j: list_min(list_transform(range(0, j + 1), lambda k: f[k + 1] + (j - k) * 2))) AS r FROM ("
    "  SELECT p_partkey, t.i + 1 AS i, n, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN (t.i + 1) * 2 ELSE least(r[j + 1] + 2, r[j] + CASE WHEN a[t.i + 1] = b[j] THEN 0 ELSE 3 END) END) AS f FROM t JOIN names USING (p_partkey) WHERE t.i < m)) "
    "SELECT p_partkey, CAST(r[n + 1] AS INTEGER) AS distance FROM t JOIN names USING (p_partkey) WHERE i = m"
)
def weighted_edit(spark, sf_dir):
    """Edit distance of part names and types, at 2 a gap and 3 a substitution."""
    return _names(spark, sf_dir).select("p_partkey", weighted_edits("a", "b").alias("distance"))


def _names(spark, sf_dir):
    letters = lambda c: F.transform(F.filter(F.split(c, ""), lambda x: x != ""), F.ascii)
    return table(spark, sf_dir, "part").select("p_partkey", letters("p_name").alias("a"), letters("p_type").alias("b"))


def affine_sql(open_: float, widen: float, local: bool, source: str, pairs: str, key: str, result: str | None = None) -> str:
    """Best scores of gapped alignments of pairs(key, a, b, m, n), row by row: h, and d, the best scores that end in a gap down."""
    floor = "greatest(0.0::DOUBLE, {})" if local else "{}"
    cell = "greatest(CASE WHEN a[t.i + 1] = b[j] THEN 3.0::DOUBLE ELSE -2.0::DOUBLE END + h[j], e[j + 1])"
    gap = f"list_max(list_transform(range(0, j), lambda k: g[k + 1] - {open_} - (j - k - 1) * {widen}))"
    best = "max(x)" if local else "max(x) FILTER (WHERE i = m OR j = n)"
    return (
        f"WITH RECURSIVE {source}, t AS (SELECT {key}, 0 AS i, list_transform(range(0, n + 1), lambda j: 0.0::DOUBLE) AS h, list_transform(range(0, n + 1), lambda j: -1e9::DOUBLE) AS d FROM {pairs} UNION ALL "
        f"SELECT {key}, i, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {floor.format(f'greatest(g[j + 1], {gap})')} END) AS h, e AS d FROM ("
        f"  SELECT {key}, t.i + 1 AS i, n, e, list_transform(range(0, n + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {floor.format(cell)} END) AS g FROM ("
        f"    SELECT {key}, t.i, n, m, a, b, h, list_transform(range(0, n + 1), lambda j: greatest(h[j + 1] - {open_}, d[j + 1] - {widen})) AS e FROM t JOIN {pairs} USING ({key}) WHERE t.i < m) t)), "
        f"cells AS (SELECT {key}, i, m, n, unnest(range(0, n + 1)) AS j, unnest(h) AS x FROM t JOIN {pairs} USING ({key})) "
    ) + (result or f"SELECT {key}, round({best}, 4) AS score FROM cells GROUP BY {key}")


@query(affine_sql(8.94, 0.88, True, _NAMES, "names", "p_partkey"))
def gapped_sw_names(spark, sf_dir):
    """Local alignment of part names and types with affine gaps."""
    return _names(spark, sf_dir).select("p_partkey", gapped_local("a", "b").alias("score"))


@query(affine_sql(3.25, 0.8942, False, _NAMES, "names", "p_partkey"))
def gapped_nw_names(spark, sf_dir):
    """Global alignment of part names and types with affine gaps, those at the ends free."""
    return _names(spark, sf_dir).select("p_partkey", gapped_global("a", "b").alias("score"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def required_rows(spark, sf_dir):
    """Rows on condition that holds for all of them."""
    rows = table(spark, sf_dir, "lineitem")
    return required(rows, F.col("l_quantity") > 0, "a quantity isn't positive").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(
    "WITH g AS (SELECT c_custkey, c_nationkey, c_acctbal, coalesce(c_acctbal - lag(c_acctbal) OVER w > 2.5, true) AS opens, row_number() OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)), "
    "c AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey ORDER BY n) AS k FROM g) "
    "SELECT c_custkey, CAST(k - 1 AS BIGINT) AS chain, CAST(min(n) OVER (PARTITION BY c_nationkey, k) AS BIGINT) AS rank FROM c"
)
def close_balances(spark, sf_dir):
    """Customers of a nation by balance, those within 2.5 of the one before tied with it."""
    ranked = close_ranks(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_acctbal", 2.5, "c_nationkey")
    return ranked.select("c_custkey", "chain", "rank")
