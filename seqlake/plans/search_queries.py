"""Queries on seeds, selection, statistics, suffixes and alignments."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchConfig
from ..operators import batches, stats
from ..operators.align import gapless_best
from ..operators.blocks import Ranking, searched
from ..operators.copies import members, spread
from ..operators.index import build_index
from ..operators.rank import FIRST_PHASE, with_letters
from ..operators.seeds import consensus, described, group_hits, seed_hits
from ..operators.structure import chain_rmsd, chain_tm, chain_within
from ..operators.fences import compared, pattern_ranges
from ..operators.suffixes import concatenated, locate, neighbour_prefixes, starts, suffix_ranks
from ..sources.files import scratch
from ..sources.views import BASKET_SQL, EVENT_SQL, EVENTS, basket_sequences, benchmark_texts, coordinates, document_texts, event_sequences, structural_sequences
from .catalog import query
from .function_queries import affine_sql
from .search import COLUMNS, edges, figured, pictures, report, reported, result_lines, search, seeded, seeded_once
from .slots import EMIT, SKIP, STOP, accumulated, handled

TEXT = SearchConfig(minimal_length=15, minimal_seed=2, maximal_match=10_000)
EVENT = SearchConfig(minimal_length=8, minimal_seed=1, maximal_match=10_000)
BASKET = SearchConfig(minimal_length=5, minimal_seed=2, maximal_match=10_000)
LETTERS = len(EVENTS)

_TEXT_HITS = """
tw AS (SELECT seq_id, c * 500 + p - 1 AS j, substr(piece, p, 15) AS w FROM (
  SELECT seq_id, c, piece, unnest(range(1, CAST(least(500, length(piece) - 14) AS BIGINT) + 1)) AS p FROM (
    SELECT seq_id, c, substr(text, c * 500 + 1, 514) AS piece FROM (SELECT doc_id AS seq_id, text, unnest(range(0, CAST(length(text) // 500 + 1 AS BIGINT))) AS c FROM documents)))),
qw AS (SELECT seq_id, p - 1 AS i, substr(text, p, 15) AS w FROM (SELECT item_id AS seq_id, text, unnest(range(1, CAST(length(text) - 14 AS BIGINT))) AS p FROM benchmark)),
hits AS (SELECT q.seq_id AS query_id, t.seq_id AS target_id, q.i, t.j FROM qw q JOIN tw t USING (w) JOIN (SELECT w FROM tw WHERE w IN (SELECT w FROM qw) GROUP BY w HAVING count(*) <= {cap}) USING (w))"""


def _hits(view: str, k: int, cap: int = 10_000) -> str:
    return f"""
tw AS (SELECT seq_id, p, letters[p + 1:p + {k}] AS w FROM (SELECT seq_id, letters, unnest(range(0, len(letters) - {k} + 1)) AS p FROM {view})),
qw AS (SELECT seq_id, p, letters[p + 1:p + {k}] AS w FROM (SELECT seq_id, letters, unnest(range(0, len(letters) - {k})) AS p FROM {view})),
hits AS (SELECT q.seq_id AS query_id, t.seq_id AS target_id, q.p AS i, t.p AS j FROM qw q JOIN tw t USING (w) JOIN (SELECT w FROM tw GROUP BY w HAVING count(*) <= {cap}) USING (w))"""


_GAPLESS = """
cells AS (SELECT query_id, target_id, i, j, CASE WHEN a[i] = b[j] THEN 3 ELSE -2 END AS s FROM (
  SELECT query_id, target_id, a, b, i, unnest(range(1, len(b) + 1)) AS j FROM (
    SELECT query_id, target_id, x.letters AS a, y.letters AS b, unnest(range(1, len(x.letters) + 1)) AS i FROM pairs JOIN {view} x ON x.seq_id = target_id JOIN {view} y ON y.seq_id = query_id))),
sums AS (SELECT *, sum(s) OVER (PARTITION BY query_id, target_id, i - j ORDER BY i) AS p FROM cells),
steps AS (SELECT query_id, target_id, i, j, p - least(0, coalesce(min(p) OVER (PARTITION BY query_id, target_id, i - j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gain FROM sums),
gains AS (SELECT query_id, target_id, gain FROM steps),
sw AS (SELECT query_id, target_id, CAST(greatest(0, max(gain)) AS INTEGER) AS swscore FROM gains GROUP BY ALL)"""

_ODDS = """
letters AS (SELECT seq_id, unnest(letters) AS letter FROM ev),
db AS (SELECT letter, count(*) / sum(count(*)) OVER () AS db FROM letters GROUP BY letter),
own AS (SELECT seq_id, letter, count(*) / sum(count(*)) OVER (PARTITION BY seq_id) AS freq FROM letters GROUP BY seq_id, letter),
odds AS (SELECT ev.seq_id, db.letter, db, coalesce(freq, 0) AS freq, CASE WHEN db.letter = 5 THEN 0.0 ELSE 10 * ln((coalesce(freq, 0) + 1e-10) / db) END AS scr
  FROM ev CROSS JOIN db LEFT JOIN own ON own.seq_id = ev.seq_id AND own.letter = db.letter)"""

_SCORED = f"WITH {EVENT_SQL}, {_hits('ev', 8)}, {_ODDS}," + """
seg AS (SELECT qw.seq_id AS query_id, p AS i, sum(scr) AS seg FROM (SELECT seq_id, p, unnest(w) AS letter FROM qw) qw JOIN odds USING (seq_id, letter) GROUP BY ALL),
pairs AS (SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds, round(sum(seg), 6) AS score, round(greatest(0, max(seg)), 6) AS blast FROM hits JOIN seg USING (query_id, i) GROUP BY ALL HAVING count(*) > 1)"""


def _top(key: str) -> str:
    return _SCORED + f" SELECT query_id, target_id, n_seeds, round({key}, 3) AS {key}, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, n_seeds DESC, target_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 10001"


def _two_phase(key: str, first: int = 1000) -> str:
    """All targets stand in the report; the gapless score of those that aren't among the first is 0."""
    return _SCORED.replace(" HAVING count(*) > 1)", ")").replace("pairs AS", "allpairs AS") + f", placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, n_seeds DESC, target_id) AS place FROM allpairs), pairs AS (SELECT query_id, target_id FROM placed WHERE place <= {first} AND n_seeds >= 1), {_GAPLESS.format(view='ev')}, done AS (SELECT query_id, target_id, n_seeds, coalesce(swscore, 0) AS swscore FROM placed LEFT JOIN sw USING (query_id, target_id) WHERE n_seeds > 1) SELECT query_id, target_id, n_seeds, swscore, CAST(row_number() OVER (PARTITION BY query_id ORDER BY swscore DESC, n_seeds DESC, target_id) AS INTEGER) AS rank FROM done QUALIFY rank <= 10001"


EVENT_PAIRS = f"WITH {EVENT_SQL}, {_hits('ev', 8)}, pairs AS (SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds FROM hits GROUP BY ALL HAVING count(*) > 1), {_GAPLESS.format(view='ev')}"


@query("WITH" + _TEXT_HITS.format(cap=10_000) + " SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds FROM hits GROUP BY ALL HAVING count(*) > 2")
def seed_search(spark, sf_dir):
    return seeded(benchmark_texts(spark, sf_dir), document_texts(spark, sf_dir), TEXT).filter("n_seeds > 2").select("query_id", "target_id", "n_seeds")


@query("WITH" + _TEXT_HITS.format(cap=10_000) + " SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds, round(avg(i), 6) AS place FROM hits GROUP BY ALL")
def stored_seed_search(spark, sf_dir):
    """The seeds of seed_search from an index in a folder, to which the documents were appended in two batches."""
    texts = document_texts(spark, sf_dir)
    index = build_index(spark, scratch(spark), TEXT.minimal_length)
    for batch in (0, 1):
        index.append(texts.filter(F.pmod("seq_id", F.lit(2)) == batch), str(batch))
    hits = index.hits(benchmark_texts(spark, sf_dir), TEXT.maximal_match)
    return hits.groupBy("query_id", "target_id").agg(F.count("*").cast("int").alias("n_seeds"), F.round(F.avg("i"), 6).alias("place"))


@query("WITH" + _TEXT_HITS.format(cap=2) + " SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds FROM hits GROUP BY ALL")
def seed_occurrence_cutoff(spark, sf_dir):
    return group_hits(seed_hits(benchmark_texts(spark, sf_dir), document_texts(spark, sf_dir), 15, 2), places=False).select("query_id", "target_id", "n_seeds")


@query("WITH" + _TEXT_HITS.format(cap=10_000) + " SELECT query_id, target_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS pos FROM hits GROUP BY ALL")
def seed_pos_list(spark, sf_dir):
    return seeded(benchmark_texts(spark, sf_dir), document_texts(spark, sf_dir), TEXT).select("query_id", "target_id", F.array_join("pos", ",").alias("pos"))


@query(f"WITH {EVENT_SQL}, {_hits('ev', 8)} SELECT query_id, CAST(i AS INTEGER) AS i, count(*) AS n FROM hits GROUP BY ALL")
def seed_consensus(spark, sf_dir):
    ev = event_sequences(spark, sf_dir)
    return consensus(seed_hits(ev, ev, 8, 10_000))


def _event_pairs(spark, sf_dir):
    """Pairs of distinct sequences."""
    ev = event_sequences(spark, sf_dir)
    return seeded_once(ev, EVENT).filter("n_seeds > 1"), ev


def _paired(spark, sf_dir, make, schema):
    """What is made of the pairs of events' sequences, found in blocks."""
    return searched(event_sequences(spark, sf_dir), EVENT.minimal_length, EVENT.maximal_match, 1, make, schema)


@query(EVENT_PAIRS + " SELECT query_id, target_id, n_seeds, swscore FROM pairs JOIN sw USING (query_id, target_id)")
def gapless_sw_score(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"n_seeds": f.n_seeds, "swscore": batches.gapless_scores(*f.letters)}, "n_seeds int, swscore int")


@query(EVENT_PAIRS + " SELECT query_id, target_id, swscore FROM sw")
def gapless_sw_diagonal(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"swscore": batches.diagonal_scores(*f.letters)}, "swscore int")


@query(
    EVENT_PAIRS + ", runs AS (SELECT *, greatest(0, gain) AS l, max(CASE WHEN gain <= 0 THEN i END) OVER (PARTITION BY query_id, target_id, i - j ORDER BY i) AS zero, min(i) OVER (PARTITION BY query_id, target_id, i - j) - 1 AS edge FROM steps), "
    "best AS (SELECT * FROM runs WHERE l > 0 QUALIFY row_number() OVER (PARTITION BY query_id, target_id ORDER BY l DESC, i, j) = 1) "
    "SELECT query_id, target_id, CAST(l AS INTEGER) AS swscore, array_to_string(list_transform(range(0, i - coalesce(zero, edge)), lambda k: (i - k) || ':' || (j - k)), ' ') AS cells FROM best"
)
def gapless_sw_traceback(spark, sf_dir):
    """The cells of each pair's best diagonal run, from its end to its start, counted from 1."""
    return _paired(spark, sf_dir, lambda f: dict(zip(("swscore", "cells"), batches.placed_texts(*f.letters))), "swscore int, cells string")


def _selected(spark, sf_dir, how, first=FIRST_PHASE):
    """The events' sequences searched in themselves, their targets selected as rank.select() says."""
    phase, aligns = how.removesuffix("_sw"), how.endswith("sw")
    ranking = Ranking("swscore" if aligns else how, EVENT.maximal_hits + 1, first if how.endswith("_sw") else None, phase)
    make = lambda f: {"n_seeds": f.n_seeds, "score": f.score, "blast": f.blast, "swscore": batches.gapless_scores(*f.letters) if aligns else np.zeros(len(f), np.int32)}
    schema = "n_seeds int, score double, blast double, swscore int, rank int"
    return searched(event_sequences(spark, sf_dir), EVENT.minimal_length, EVENT.maximal_match, EVENT.minimal_seed, make, schema, None if how == "sw" else LETTERS, ranking)


@query(EVENT_PAIRS + " SELECT query_id, target_id, n_seeds, swscore, CAST(row_number() OVER (PARTITION BY query_id ORDER BY swscore DESC, n_seeds DESC, target_id) AS INTEGER) AS rank FROM pairs JOIN sw USING (query_id, target_id)")
def rank_sw_topk(spark, sf_dir):
    return _selected(spark, sf_dir, "sw").select("query_id", "target_id", "n_seeds", "swscore", "rank")


@query(_top("score"))
def rank_score_topk(spark, sf_dir):
    return _selected(spark, sf_dir, "score").select("query_id", "target_id", "n_seeds", F.round("score", 3).alias("score"), "rank")


@query(_top("blast"))
def rank_blast_topk(spark, sf_dir):
    return _selected(spark, sf_dir, "blast").select("query_id", "target_id", "n_seeds", F.round("blast", 3).alias("blast"), "rank")


@query(_two_phase("score"))
def two_phase_score_sw(spark, sf_dir):
    return _selected(spark, sf_dir, "score_sw").select("query_id", "target_id", "n_seeds", "swscore", "rank")


@query(_two_phase("blast"))
def two_phase_blast_sw(spark, sf_dir):
    return _selected(spark, sf_dir, "blast_sw").select("query_id", "target_id", "n_seeds", "swscore", "rank")


@query(_two_phase("score", 5))
def two_phase_score_cut(spark, sf_dir):
    """The first phase passes five targets a query, so most of them have no gapless score."""
    return _selected(spark, sf_dir, "score_sw", 5).select("query_id", "target_id", "n_seeds", "swscore", "rank")


@query(f"WITH {BASKET_SQL}, {_hits('ba', 5)} SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds FROM hits GROUP BY ALL HAVING count(*) > 2")
def basket_seed_search(spark, sf_dir):
    ba = basket_sequences(spark, sf_dir)
    return searched(ba, BASKET.minimal_length, BASKET.maximal_match, 2, lambda f: {"n_seeds": f.n_seeds}, "n_seeds int", nulls=True)


@query(f"WITH {EVENT_SQL}, {_ODDS} SELECT seq_id, letter, round(freq, 6) AS freq FROM own")
def letter_freq_seq(spark, sf_dir):
    return stats.sequence_frequencies(event_sequences(spark, sf_dir)).select("seq_id", "letter", F.round("freq", 6).alias("freq"))


@query(f"WITH {BASKET_SQL}, l AS (SELECT unnest(letters) AS letter FROM ba) SELECT letter, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS freq FROM l GROUP BY letter")
def letter_freq_db(spark, sf_dir):
    return stats.database_frequencies(basket_sequences(spark, sf_dir)).select("letter", "n", F.round("freq", 6).alias("freq"))


@query(f"WITH {EVENT_SQL}, {_ODDS} SELECT seq_id, letter, round(scr, 4) AS scr FROM odds")
def log_odds(spark, sf_dir):
    return stats.log_odds(event_sequences(spark, sf_dir), LETTERS).select("seq_id", "letter", F.round("scr", 4).alias("scr"))


@query(f"WITH {EVENT_SQL}, {_ODDS} SELECT seq_id, round(sum(db * scr), 4) AS e_score FROM odds GROUP BY seq_id")
def expected_score(spark, sf_dir):
    return stats.log_odds(event_sequences(spark, sf_dir), LETTERS).groupBy("seq_id").agg(F.round(F.sum(F.col("db") * F.col("scr")), 4).alias("e_score"))


@query(f"WITH {EVENT_SQL}, {_ODDS} SELECT seq_id, round(sum(scr), 4) AS input_score FROM letters JOIN odds USING (seq_id, letter) GROUP BY seq_id")
def input_score(spark, sf_dir):
    ev = event_sequences(spark, sf_dir)
    letters = ev.select("seq_id", F.explode("letters").alias("letter"))
    return letters.join(stats.log_odds(ev, LETTERS), ["seq_id", "letter"]).groupBy("seq_id").agg(F.round(F.sum("scr"), 4).alias("input_score"))


@query(f"WITH {EVENT_SQL}, {_ODDS}, joint AS (SELECT seq_id, letter, freq * db AS x FROM odds), t AS (SELECT *, sum(x) OVER (PARTITION BY seq_id) AS total FROM joint) SELECT seq_id, letter, round(CASE WHEN total > 1e-4 THEN x / total ELSE x END, 6) AS p FROM t")
def score_freq(spark, sf_dir):
    joint = stats.log_odds(event_sequences(spark, sf_dir), LETTERS).withColumn("x", F.col("freq") * F.col("db"))
    total = F.sum("x").over(Window.partitionBy("seq_id"))
    return joint.select("seq_id", "letter", F.round(F.when(total > 1e-4, F.col("x") / total).otherwise(F.col("x")), 6).alias("p"))


@query(f"WITH {EVENT_SQL}, {_ODDS} SELECT seq_id, round(sum(freq * log2(freq)), 6) AS entropy FROM own GROUP BY seq_id")
def entropy(spark, sf_dir):
    own = stats.sequence_frequencies(event_sequences(spark, sf_dir))
    return own.groupBy("seq_id").agg(F.round(F.sum(F.col("freq") * F.log2("freq")), 6).alias("entropy"))


@query(f"WITH {EVENT_SQL} SELECT seq_id, round(list_sum(letters) / len(letters), 6) AS score FROM ev")
def direct_score(spark, sf_dir):
    total = F.aggregate("letters", F.lit(0), lambda a, x: a + x)
    return event_sequences(spark, sf_dir).select("seq_id", F.round(total / F.size("letters"), 6).alias("score"))


@query(
    "WITH RECURSIVE " + EVENT_SQL + ", " + _ODDS + """, lists AS (SELECT seq_id, list(db ORDER BY letter) AS p, list(scr ORDER BY letter) AS s FROM odds GROUP BY seq_id),
f AS (SELECT *, list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k] * exp(1e-4 * s[k]))) - 1 AS f0, list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k] * exp(s[k]))) - 1 AS f1 FROM lists),
steps AS (SELECT seq_id, p, s, 1e-4::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS n FROM f WHERE f0 < 0 AND f1 > 0 UNION ALL
  SELECT seq_id, p, s, CASE WHEN v < 0 THEN mid ELSE lo END, CASE WHEN v < 0 THEN hi ELSE mid END, n + 1 FROM (
    SELECT *, list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k] * exp((lo + hi) / 2 * s[k]))) - 1 AS v, (lo + hi) / 2 AS mid FROM steps WHERE n < 60)),
roots AS (SELECT f.seq_id, f.p, f.s, coalesce((lo + hi) / 2, 0) AS decay FROM f LEFT JOIN (SELECT * FROM steps WHERE n = 60) USING (seq_id))
SELECT seq_id, round(decay, 5) AS decay, round(list_sum(list_transform(range(1, len(p) + 1), lambda k: p[k] * exp(decay * s[k]))), 4) AS total FROM roots"""
)
def lambda_check(spark, sf_dir):
    found = stats.extreme_values(stats.score_lists(stats.log_odds(event_sequences(spark, sf_dir), LETTERS)))
    return found.select("seq_id", F.round("lambda", 5).alias("decay"), F.round("check", 4).alias("total"))


@query()
def karlin_k(spark, sf_dir):
    return stats.extreme_values(stats.score_lists(stats.log_odds(event_sequences(spark, sf_dir), LETTERS)))


@query(f"WITH {EVENT_SQL}, x AS (SELECT seq_id, CAST(p AS INTEGER) AS pos, letters[p + 1:] AS suffix FROM (SELECT seq_id, letters, unnest(range(0, len(letters))) AS p FROM ev)) SELECT seq_id, pos, row_number() OVER (ORDER BY suffix, seq_id, pos) - 1 AS rank FROM x")
def suffix_rank(spark, sf_dir):
    return suffix_ranks(event_sequences(spark, sf_dir))[0].select("seq_id", "pos", "rank")


@query(
    f"WITH {EVENT_SQL}, x AS (SELECT seq_id, CAST(p AS INTEGER) AS pos, letters[p + 1:] AS suffix FROM (SELECT seq_id, letters, unnest(range(0, len(letters))) AS p FROM ev)), y AS (SELECT *, lag(suffix) OVER (ORDER BY suffix, seq_id, pos) AS last FROM x) "
    "SELECT seq_id, pos, CASE WHEN last IS NULL THEN 0 ELSE CAST(coalesce(list_min(list_filter(range(1, least(len(suffix), len(last)) + 1), lambda i: suffix[i] <> last[i])) - 1, least(len(suffix), len(last))) AS INTEGER) END AS lcp FROM y"
)
def suffix_lcp(spark, sf_dir):
    return neighbour_prefixes(event_sequences(spark, sf_dir)).select("seq_id", "pos", "lcp")


@query(
    f"WITH {EVENT_SQL}, x AS (SELECT seq_id, p AS pos, letters[p + 1:] AS suffix FROM (SELECT seq_id, letters, unnest(range(0, len(letters))) AS p FROM ev)), r AS (SELECT *, row_number() OVER (ORDER BY suffix, seq_id, pos) - 1 AS rank FROM x), "
    "pat AS (SELECT DISTINCT pattern FROM (SELECT letters[p + 1:p + k] AS pattern FROM (SELECT letters, k, unnest(range(0, len(letters), 7)) AS p FROM ev, range(1, 7) t(k))) UNION SELECT [1, 0, 2] UNION SELECT letters FROM ev UNION SELECT list_append(letters[5:], 9) FROM ev) "
    "SELECT array_to_string(pattern, '-') AS pattern, CAST(coalesce(min(rank), 1) AS BIGINT) AS a, CAST(coalesce(max(rank), 0) AS BIGINT) AS b FROM pat LEFT JOIN r ON r.suffix[1:len(pattern)] = pattern GROUP BY ALL"
)
def pattern_range(spark, sf_dir):
    """Patterns of one to six letters, from every seventh place of each sequence, whole sequences, and some that occur nowhere."""
    ev = event_sequences(spark, sf_dir)
    places = F.sequence(F.lit(0), F.size("letters") - 1, F.lit(7))
    cut = F.flatten(F.transform(places, lambda p: F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.slice("letters", p + 1, k))))
    long = F.array(F.col("letters"), F.array_append(F.slice("letters", 5, F.size("letters")), F.lit(9)))
    patterns = ev.select(F.explode(F.concat(cut, long)).alias("pattern")).unionAll(spark.range(1).select(F.array(F.lit(1), F.lit(0), F.lit(2)))).distinct()
    return pattern_ranges(ev, patterns).select(F.array_join("pattern", "-").alias("pattern"), "a", "b")


@query(
    f"WITH {EVENT_SQL}, x AS (SELECT seq_id, CAST(p AS INTEGER) AS pos, letters[1:12] AS pattern, letters[p + 1:] AS suffix FROM (SELECT seq_id, letters, unnest(range(0, len(letters))) AS p FROM ev)), "
    "y AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(pattern), len(suffix)) + 1), lambda i: pattern[i] <> suffix[i])) - 1, least(len(pattern), len(suffix))) AS lcp FROM x) "
    "SELECT seq_id, pos, CAST(lcp AS INTEGER) AS lcp, CASE WHEN lcp = len(pattern) THEN 0 WHEN pattern < suffix THEN -1 ELSE 1 END AS sign FROM y"
)
def pattern_compare(spark, sf_dir):
    """Each sequence's first twelve letters against all its suffixes: letters in common, and which comes first."""
    ev = event_sequences(spark, sf_dir)
    suffixes = F.transform(F.sequence(F.lit(0), F.size("letters") - 1), lambda p: F.slice("letters", p + 1, F.size("letters")))
    rows = ev.select("seq_id", F.slice("letters", 1, 12).alias("pattern"), F.posexplode(suffixes).alias("pos", "suffix"))
    return rows.select("seq_id", "pos", compared(F.col("pattern"), F.col("suffix")).alias("c")).select("seq_id", "pos", "c.*")


_STARTS = "s AS (SELECT seq_id, sum(len(letters) + 1) OVER (ORDER BY seq_id) - len(letters) - 1 AS start, letters FROM ev)"


@query(f"WITH {EVENT_SQL}, {_STARTS} SELECT CAST(start + i - 1 AS BIGINT) AS place, CAST(CASE WHEN i <= len(letters) THEN letters[i] WHEN start = (SELECT max(start) FROM s) THEN 4001 ELSE 4000 END AS INTEGER) AS letter FROM (SELECT *, unnest(range(1, len(letters) + 2)) AS i FROM s)")
def concat_delimited_sequences(spark, sf_dir):
    return concatenated(event_sequences(spark, sf_dir))


@query(f"WITH {EVENT_SQL}, {_STARTS} SELECT event_id AS place, seq_id, CAST(event_id - start AS BIGINT) AS pos FROM (SELECT DISTINCT event_id FROM events) JOIN s ON event_id BETWEEN start AND start + len(letters) - 1")
def seq_locate_interval(spark, sf_dir):
    places = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("place")).distinct()
    return locate(places, starts(event_sequences(spark, sf_dir)))


@query(
    EVENT_PAIRS.replace(f", {_GAPLESS.format(view='ev')}", "")
    + ", bars AS (SELECT query_id, target_id, list(DISTINCT CAST(floor(i * least(20, len(letters) - 8) / (len(letters) - 8)) AS INTEGER)) AS marks, least(20, any_value(len(letters)) - 8) AS n FROM hits JOIN pairs USING (query_id, target_id) JOIN ev ON seq_id = query_id GROUP BY query_id, target_id) "
    "SELECT query_id, target_id, array_to_string(list_transform(range(0, n), lambda k: CASE WHEN list_contains(marks, k) THEN '*' ELSE '-' END), '') AS picture FROM bars"
)
def match_picture(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"picture": pictures(f, 8)}, "picture string")


def event_report(spark, sf_dir, ranked=False, aligned_too=True):
    return reported(event_sequences(spark, sf_dir), EVENT, LETTERS, ranked, aligned_too)


@query()
def search_report(spark, sf_dir):
    """The 21 columns, with column names that any sink takes."""
    rows = event_report(spark, sf_dir)
    return rows.select(*(F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in COLUMNS))


@query()
def result_row(spark, sf_dir):
    return result_lines(event_report(spark, sf_dir))


def _chains(spark, sf_dir):
    """Each embedding's chain with that of the next label member."""
    rows = coordinates(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("seq_id"), "label"), "seq_id")
    near = Window.partitionBy("label").orderBy("seq_id")
    return rows.select("seq_id", "xyz", F.lead("seq_id").over(near).alias("other"), F.lead("xyz").over(near).alias("xyz2")).filter("other is not null")


@query()
def tm_score(spark, sf_dir):
    return _chains(spark, sf_dir).select("seq_id", "other", chain_tm("xyz", "xyz2").alias("tm"))


_CHAINS = """
pts AS (SELECT vec_id AS seq_id, label, k, embedding[3 * k + 1]::DOUBLE AS x, embedding[3 * k + 2]::DOUBLE AS y, embedding[3 * k + 3]::DOUBLE AS z FROM (SELECT *, unnest(range(0, 21)) AS k FROM embeddings)),
nxt AS (SELECT vec_id AS seq_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS other FROM embeddings),
two AS (SELECT n.seq_id, n.other, a.k, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM nxt n JOIN pts a ON a.seq_id = n.seq_id JOIN pts b ON b.seq_id = n.other AND b.k = a.k)"""


@query(f"""WITH RECURSIVE {_CHAINS},
c AS (SELECT seq_id, other, ax - avg(ax) OVER w AS ax, ay - avg(ay) OVER w AS ay, az - avg(az) OVER w AS az, bx - avg(bx) OVER w AS bx, by_ - avg(by_) OVER w AS by_, bz - avg(bz) OVER w AS bz FROM two WINDOW w AS (PARTITION BY seq_id, other)),
s AS (SELECT seq_id, other, count(*) AS n, sum(ax * ax + ay * ay + az * az + bx * bx + by_ * by_ + bz * bz) AS g,
  sum(ax * bx) AS xx, sum(ax * by_) AS xy, sum(ax * bz) AS xz, sum(ay * bx) AS yx, sum(ay * by_) AS yy, sum(ay * bz) AS yz, sum(az * bx) AS zx, sum(az * by_) AS zy, sum(az * bz) AS zz FROM c GROUP BY ALL),
k AS (SELECT seq_id, other, n, g, [[xx + yy + zz, yz - zy, zx - xz, xy - yx], [yz - zy, xx - yy - zz, xy + yx, zx + xz], [zx - xz, xy + yx, yy - xx - zz, yz + zy], [xy - yx, zx + xz, yz + zy, zz - xx - yy]] AS m FROM s),
p AS (SELECT seq_id, other, n, g, list_transform(m, lambda r, i: list_transform(r, lambda x, j: x + CASE WHEN i = j THEN g / 2 ELSE 0 END)) AS m, 0 AS t FROM k UNION ALL
  SELECT seq_id, other, n, g, list_transform(sq, lambda r: list_transform(r, lambda x: x / top)), t + 1 FROM (
    SELECT *, list_max(list_transform(sq, lambda r: list_max(list_transform(r, lambda x: abs(x))))) AS top FROM (
      SELECT *, list_transform(m, lambda r: list_transform(range(1, 5), lambda j: r[1] * m[1][j] + r[2] * m[2][j] + r[3] * m[3][j] + r[4] * m[4][j])) AS sq FROM p WHERE t < 40)))
SELECT seq_id, other, round(sqrt(greatest(0, g - 2 * list_sum(list_transform(range(1, 5), lambda i: q[i] * list_dot_product(k.m[i], q))) / list_dot_product(q, q)) / n), 6) AS rmsd
FROM (SELECT seq_id, other, m[list_position(d, list_max(d))] AS q FROM (SELECT *, [m[1][1], m[2][2], m[3][3], m[4][4]] AS d FROM p WHERE t = 40)) JOIN k USING (seq_id, other)""")
def kabsch_rmsd(spark, sf_dir):
    return _chains(spark, sf_dir).select("seq_id", "other", chain_rmsd("xyz", "xyz2").alias("rmsd"))


@query(f"""WITH {_CHAINS},
d AS (SELECT p.seq_id, p.other, p.k, sqrt(avg((sqrt((p.ax - q.ax) ** 2 + (p.ay - q.ay) ** 2 + (p.az - q.az) ** 2) - sqrt((p.bx - q.bx) ** 2 + (p.by_ - q.by_) ** 2 + (p.bz - q.bz) ** 2)) ** 2)) AS d FROM two p JOIN two q USING (seq_id, other) GROUP BY ALL)
SELECT seq_id, other, round(avg(CASE WHEN d <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share FROM d GROUP BY ALL""")
def dme_fraction(spark, sf_dir):
    return _chains(spark, sf_dir).select("seq_id", "other", chain_within("xyz", "xyz2").alias("share"))


@query(
    EVENT_PAIRS.replace(f", {_GAPLESS.format(view='ev')}", "") + f", {_ODDS}, seg AS (SELECT qw.seq_id AS query_id, p AS i, sum(scr) AS seg FROM (SELECT seq_id, p, unnest(w) AS letter FROM qw) qw JOIN odds USING (seq_id, letter) GROUP BY ALL), "
    "scores AS (SELECT query_id, target_id, sum(seg) AS score, greatest(0, max(seg)) AS blast FROM hits JOIN seg USING (query_id, i) GROUP BY ALL) "
    "SELECT CAST(query_id AS VARCHAR) AS sequence_a, CAST(target_id AS VARCHAR) AS sequence_b, n_seeds AS matches, round(score, 3) AS matches_score, round(blast, 3) AS matches_blast, CAST(target_id AS INTEGER) AS matchtype_id, '' AS description FROM pairs JOIN scores USING (query_id, target_id)"
)
def report_columns(spark, sf_dir):
    """The report's columns that no alignment has a part in."""
    rows = event_report(spark, sf_dir, aligned_too=False)
    return rows.select(F.col("sequence a").alias("sequence_a"), F.col("sequence b").alias("sequence_b"), "matches", F.round("matches_score", 3).alias("matches_score"), F.round("matches_blast", 3).alias("matches_blast"), "matchtype_id", "description")


@query(f"WITH {EVENT_SQL}, {_hits('ev', 8)} SELECT query_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, target_id, 'user ' || target_id AS description FROM hits JOIN (SELECT query_id, i FROM hits GROUP BY ALL HAVING count(*) > 1) USING (query_id, i)")
def reported_suffixes(spark, sf_dir):
    """The sequences that hold each window of a query that stands more than once in the database."""
    ev = event_sequences(spark, sf_dir).withColumn("description", F.concat(F.lit("user "), F.col("seq_id").cast("string")))
    return described(seed_hits(ev, ev, 8, 10_000), ev, 1)


#: Letters of structural sequences hardly repeat, so a single one is a seed.
STRUCTURE = SearchConfig(kind="structure", minimal_length=1, minimal_seed=1, maximal_match=10_000)


def _structural(spark, sf_dir):
    st = structural_sequences(spark, sf_dir)
    return search(st, st, STRUCTURE), st


@query()
def structure_report(spark, sf_dir):
    """A structural search: profiles aligned globally and locally, chains scored on the aligned positions."""
    hits, st = _structural(spark, sf_dir)
    rows = report(hits, st, st, STRUCTURE)
    return rows.select(*(F.col(f"`{c}`").alias(c.replace(" ", "_")) for c in COLUMNS))


@query()
def edge_list(spark, sf_dir):
    """The structural report as a graph weighted by TM-score."""
    hits, st = _structural(spark, sf_dir)
    return edges(report(hits, st, st, STRUCTURE))


_PAIR_LETTERS = EVENT_PAIRS.removeprefix("WITH ").replace(f", {_GAPLESS.format(view='ev')}", "") + ", both_letters AS (SELECT query_id, target_id, x.letters AS a, y.letters AS b, CAST(len(x.letters) AS BIGINT) AS m, CAST(len(y.letters) AS BIGINT) AS n FROM pairs JOIN ev x ON x.seq_id = target_id JOIN ev y ON y.seq_id = query_id)"
_BOTH = (_PAIR_LETTERS, "both_letters", "query_id, target_id")


@query(affine_sql(8.94, 0.88, True, *_BOTH))
def gapped_sw(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"score": np.round(batches.affine_scores(*f.letters, 8.94, 0.88, True), 4)}, "score double")


@query(affine_sql(3.25, 0.8942, False, *_BOTH))
def gapped_nw(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"score": np.round(batches.affine_scores(*f.letters, 3.25, 0.8942, False), 4)}, "score double")


@query(
    affine_sql(
        5, 5, True, *_BOTH,
        ", hs AS (SELECT query_id, target_id, list(h ORDER BY i) AS hs FROM t GROUP BY ALL), "
        "way AS (SELECT query_id, target_id, i, j, CASE WHEN x > 0 THEN [i, j] ELSE [] END AS cells, x AS v FROM (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY query_id, target_id ORDER BY x DESC, i, j) = 1) UNION ALL "
        "SELECT query_id, target_id, i, j, CASE WHEN hs[i + 1][j + 1] > 0 THEN cells || [i, j] ELSE cells END, hs[i + 1][j + 1] FROM ("
        "SELECT query_id, target_id, hs, cells, CASE WHEN v = hs[i + 1][j] - 5 AND v <> hs[i][j + 1] - 5 THEN i ELSE i - 1 END AS i, CASE WHEN v = hs[i][j + 1] - 5 THEN j ELSE j - 1 END AS j FROM way JOIN hs USING (query_id, target_id) WHERE v > 0)) "
        "SELECT query_id, target_id, array_to_string(cells, ' ') AS cells FROM way WHERE v = 0",
    ).replace(" , hs AS", ", hs AS")
)
def sw_traceback(spark, sf_dir):
    """The cells of each pair's best local alignment with a linear gap cost, from its end to its start, counted from 1."""
    return _paired(spark, sf_dir, lambda f: {"cells": batches.linear_texts(*f.letters)}, "cells string")


@query()
def alt_score_z(spark, sf_dir):
    return _paired(spark, sf_dir, lambda f: {"z": figured(f)["z"]}, "z double").withColumn("z", F.round("z", 6))


class Places:
    """A filter: how many seeds a pair has, and where they stand in the query."""

    def __init__(self):
        self.places = []

    def add(self, row):
        self.places.append(row["i"])

    def results(self):
        yield len(self.places), ",".join(map(str, self.places))


class GaplessScore:
    """A filter: the gapless score of a pair, whose row has both sequences' letters."""

    def add(self, row):
        self.n, self.score = row["n_seeds"], gapless_best(np.array(row["a"]), np.array(row["b"]))

    def results(self):
        yield self.n, int(self.score)


@query("WITH" + _TEXT_HITS.format(cap=10_000) + " SELECT query_id, target_id, CAST(count(*) AS INTEGER) AS n_seeds, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS pos FROM hits GROUP BY ALL")
def filter_slot(spark, sf_dir):
    """A caller's filter in place of the library's grouping of hits."""
    hits = seed_hits(benchmark_texts(spark, sf_dir), document_texts(spark, sf_dir), 15, 10_000)
    return accumulated(hits, Places, "n_seeds int, pos string", "i")


@query(EVENT_PAIRS + ", ranked AS (SELECT query_id, target_id, n_seeds, swscore, CAST(row_number() OVER (PARTITION BY query_id ORDER BY swscore DESC, n_seeds DESC, target_id) AS INTEGER) AS rank FROM pairs JOIN sw USING (query_id, target_id)) SELECT * FROM ranked WHERE rank <= 20 AND target_id <> query_id")
def handler_slot(spark, sf_dir):
    """A caller's filter scores the pairs, and a caller's handler skips the query itself and stops after twenty ranks."""
    pairs, ev = _event_pairs(spark, sf_dir)
    scored = accumulated(with_letters(pairs, ev, ev), GaplessScore, "n_seeds int, swscore int")
    best = Window.partitionBy("query_id").orderBy(F.desc("swscore"), F.desc("n_seeds"), "target_id")
    ranked = spread(scored, members(ev), "target_id", "target_rep").withColumn("rank", F.row_number().over(best))
    ranked = spread(ranked, members(ev), "query_id", "query_rep").filter("query_id is not null and target_id is not null")
    return handled(ranked.select("query_id", "target_id", "n_seeds", "swscore", "rank"), lambda row: STOP if row["rank"] > 20 else SKIP if row["target_id"] == row["query_id"] else EMIT)
