"""More of the library's queries: reports over points, resamples, runs, names, forms of texts, files written and read.

The stand-ins are those of :mod:`corpusloom.plans.catalogue`, where the queries are registered too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import unicode as U
from ..operators import chrf, collapse, curves, facts, leaks, mixture, packing, reports, runs, statistics, turns
from ..session import shared_dir, written
from ..sources import files, tables
from ..streaming import logs
from .catalogue import CORPUS, LOG, PER_TEXT, POINTS, REPLIES, TURNS, _LISTED, _SCORED, _listing, _names, _pairs, _scored, conversations, corpus, key_sql, log, per_text, points, query, replies, table, tokens_sql, words_sql


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


# --- forms of texts ------------------------------------------------------------------------------------------------------

#: ``e`` with an accent in two characters, and ``s`` as the long one.
_APART = "e\u0301"


@query(f"SELECT doc_id, md5(nfc_normalize(replace(text, 'e', '{_APART}'))) AS composed FROM documents")
def normal_forms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(U.nfc(F.replace("text", F.lit("e"), F.lit(_APART)))).alias("composed"))


@query(f"SELECT doc_id, md5({key_sql(f'''nfc_normalize(replace(text, 'e', '{_APART}'))''')}) AS relaxed FROM documents")
def decomposed_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.key(F.replace("text", F.lit("e"), F.lit(_APART)))).alias("relaxed"))


@query(f"SELECT doc_id, md5({key_sql('text')}) AS relaxed FROM documents")
def long_s_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.key(F.replace("text", F.lit("s"), F.lit("ſ")))).alias("relaxed"))


_HELD_APART = f"held AS (SELECT DISTINCT {key_sql('text')} AS k FROM benchmark)"


@query(f"WITH {_HELD_APART} SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM held WHERE k = {key_sql('text')} OR length(k) >= 40 AND contains({key_sql('text')}, k))")
def leaks_of_other_forms(spark, sf_dir):
    """Held-out texts are in form D here; documents that leak them are found all the same."""
    held = leaks.held_out_keys(table(spark, sf_dir, "benchmark").select(F.lit("c").alias("capacite"), U.nfd(F.col("text")).alias("text")))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.lit("*").alias("part"), "text")
    found = leaks.inspected(rows, held.select(F.lit("*").alias("part"), "held_key"))
    return found.filter("leak IS NOT NULL").select(F.col("row_id").alias("doc_id"))


@query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'Traduis cette phrase en mooré.' || chr(10) || chr(10) || text WHEN 1 THEN 'Traduis cette phrase en français.' || chr(10) || chr(10) || text END AS prompt FROM conversations")
def translation_prompts(spark, sf_dir):
    direction = F.element_at(F.array(*map(F.lit, ("french_to_moore", "moore_to_french", "other"))), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.translation_prompt(F.col("text"), direction).alias("prompt"))


@query("SELECT o_orderkey, replace(CAST(o_custkey AS VARCHAR) || '.5', '.', ',') AS number FROM orders")
def decimal_commas(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.decimal_comma(F.col("o_custkey") + 0.5).alias("number"))


@query(f"WITH {REPLIES} SELECT conv_id, pos, list_sum(list_transform({tokens_sql('obtenu')}, lambda w: length(w))) AS letters, CAST(len({tokens_sql('obtenu')}) AS BIGINT) AS tokens FROM replies")
def token_counts(spark, sf_dir):
    """Tokens by words, and by a tokenizer that gives each word's length as its id."""
    from ..functions import tokens

    def load():
        return lambda text: [len(w) for w in text.split()]

    rows = replies(spark, sf_dir)
    letters = F.aggregate(tokens.token_ids(F.col("obtenu"), load), F.lit(0).cast("long"), lambda n, x: n + x)
    return rows.select("conv_id", "pos", F.when(T.tokens(F.col("obtenu")) != F.array().cast("array<string>"), letters).alias("letters"), tokens.token_count(F.col("obtenu")).alias("tokens"))


# --- names, paths, numbers ----------------------------------------------------------------------------------------------

_PATHS = (
    "/content/cpt/A-20260831-1024/checkpoint-{n}", "/content/cpt/P2-20260831-1024/checkpoint-{n}", "/content/cpt/Z-20260831-1024/checkpoint-{n}", "/content/other/checkpoint-{n}", "/content/cpt/B-2026-1024/checkpoint-{n}", "",
)
_POINTS = ("checkpoint-{n}", "A-{n}-checkpoint-{n}", "base", "final {n}b7", "x-checkpoint-", "C-{n}-checkpoint-{n}x")


def _picked(templates, n, k):
    """One of the templates for each row, with its number put in."""
    chosen = F.element_at(F.array(*map(F.lit, templates)), (F.pmod(k, F.lit(len(templates))) + 1).cast("int"))
    return F.replace(chosen, F.lit("{n}"), n.cast("string"))


def _picked_sql(templates, n, k):
    return f"replace(({_names(templates)})[{k} % {len(templates)} + 1], '{{n}}', CAST({n} AS VARCHAR))"


_NAMED = f"named AS (SELECT o_orderkey, {_picked_sql(_PATHS, 'o_custkey', 'o_orderkey')} AS path, {_picked_sql(_POINTS, 'o_custkey', 'o_orderkey // 7')} AS point FROM orders)"
_PARTS = "list_filter(string_split(path, '/'), lambda p: contains(p, '-') AND NOT starts_with(p, 'checkpoint'))"
_TAIL = "CASE WHEN contains(point, 'checkpoint-') THEN regexp_extract(point, '.*checkpoint-(.*)$', 1) ELSE point END"


def _named(spark, sf_dir):
    o, number = table(spark, sf_dir, "orders"), F.col("o_custkey")
    return o.select("o_orderkey", _picked(_PATHS, number, F.col("o_orderkey")).alias("path"), _picked(_POINTS, number, F.floor(F.col("o_orderkey") / 7)).alias("point"))


@query(
    f"""WITH {_NAMED}, d AS (SELECT *, regexp_replace({_TAIL}, '[^0-9]', '', 'g') AS digits FROM named)
SELECT o_orderkey, CASE WHEN point = 'base' THEN 'base' ELSE coalesce(string_split({_PARTS}[-1], '-')[1], '?') END AS arm, CASE WHEN point = 'base' THEN 0 ELSE 1 END AS kind,
  CASE WHEN point = 'base' OR digits = '' THEN 0 ELSE CAST(digits AS BIGINT) END AS step, CASE WHEN regexp_matches(path, '/cpt/(A|P2|B)-[0-9]{{8}}-[0-9]{{4}}/checkpoint-[0-9]+$') THEN regexp_extract(path, '/cpt/([A-Z0-9]+)-', 1) END AS run_arm,
  regexp_matches(point, '^(A|B|C|P|P2)-[0-9]+-checkpoint-[0-9]+$') AS arm_point, CASE WHEN regexp_matches(point, '^[^-]*@') THEN point ELSE point END AS unchanged FROM d"""
)
def path_projections(spark, sf_dir):
    """Arms and steps of paths and names of every kind: known and unknown arms, no arm, the base, names without digits."""
    order = curves.order_key(F.col("point"))
    parts = curves.path_parts(F.col("path"), ["A", "B", "P2"])
    return _named(spark, sf_dir).select(
        "o_orderkey", curves.arm_of(F.col("point"), F.col("path")).alias("arm"), order["kind"].alias("kind"), order["step"].alias("step"), parts["arm"].alias("run_arm"),
        curves.is_arm_point(F.col("point")).alias("arm_point"), curves.run_label(F.col("point")).alias("unchanged"),
    )


@query(
    """WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'base' ELSE chr(CAST(65 + o_orderkey % 3 AS INTEGER)) END AS arm, CASE WHEN o_orderkey % 5 = 0 THEN 'base' ELSE 'checkpoint-' || o_custkey END AS point FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN arm ELSE arm || '-' || split_part(point, '-', 2) END AS label, CASE WHEN arm = 'base' THEN point ELSE arm || '/' || point END AS display,
  translate(arm || '+' || point || '/x', '+/', '__') AS file, CASE WHEN o_orderkey % 5 = 0 THEN 'base' ELSE CAST(split_part(point, '-', 2) AS VARCHAR) END AS answer_step, coalesce(MAP {'A': 'un', 'B': 'deux'}[arm], '?') AS share FROM s"""
)
def point_names(spark, sf_dir):
    arm = F.when(F.pmod("o_orderkey", F.lit(4)) == 0, "base").otherwise(F.char(65 + F.pmod("o_orderkey", F.lit(3))))
    point = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "base").otherwise(F.concat(F.lit("checkpoint-"), F.col("o_custkey").cast("string")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", arm.alias("arm"), point.alias("point"))
    start = F.when(F.col("point") == "base", F.col("arm")).otherwise(F.concat("arm", F.lit("@"), "point"))
    return rows.select(
        "o_orderkey", curves.run_label(start).alias("label"), curves.display_name(F.col("arm"), F.col("point")).alias("display"), T.file_name(F.concat("arm", F.lit("+"), "point", F.lit("/x"))).alias("file"),
        collapse.answer_key(F.col("arm"), F.col("point"))["step"].alias("answer_step"), mixture.label_of(F.col("arm"), {"A": "un", "B": "deux"}).alias("share"),
    )


_ASKED = """asked AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 320 WHEN o_orderkey % 3 = 1 THEN 128 END AS budget, CASE o_custkey % 4 WHEN 0 THEN ['a', 'b'] WHEN 1 THEN ['b', 'a', 'a'] WHEN 2 THEN ['a'] ELSE CAST([] AS VARCHAR[]) END AS ids,
  o_orderkey % 2 = 0 AS whole FROM orders)"""


@query(
    f"""WITH {_ASKED}, b AS (SELECT *, coalesce(budget, CASE WHEN len(ids) > 0 AND whole THEN 128 ELSE 48 END) AS told FROM asked)
SELECT o_orderkey, told, told = 320 AND list_sort(list_distinct(ids)) = ['a', 'b'] AS answers_probe, told = 128 AND list_sort(list_distinct(ids)) = ['a'] AS same_as_first FROM b"""
)
def asked_items(spark, sf_dir):
    """Budgets told from points, and whether two points were asked the same."""
    k, c = F.col("o_orderkey"), F.pmod("o_custkey", F.lit(4))
    ids = F.when(c == 0, F.array(F.lit("a"), F.lit("b"))).when(c == 1, F.array(F.lit("b"), F.lit("a"), F.lit("a"))).when(c == 2, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    complete = F.when(F.pmod(k, F.lit(2)) == 0, True)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.pmod(k, F.lit(3)) == 0, 320).when(F.pmod(k, F.lit(3)) == 1, 128).alias("budget"), ids.alias("ids"), complete.alias("complete"))
    faits = F.transform("ids", lambda i: F.struct(i.alias("id"), F.col("complete").alias("complet")))
    told = rows.withColumn("told", facts.budget_of(F.col("budget"), faits))
    probe = F.array(F.lit("b"), F.lit("a"))
    same = curves.same_items(F.col("told"), F.col("ids"), F.lit(128), F.array(F.lit("a")))
    return told.select("o_orderkey", "told", facts.answers_the_probe(F.col("told"), F.col("ids"), probe).alias("answers_probe"), same.alias("same_as_first"))


_BOUNDS = "bounds AS (SELECT o_orderkey, CAST(o_custkey % 40 AS DOUBLE) AS low, CAST(o_custkey % 40 + o_orderkey % 9 AS DOUBLE) AS high FROM orders)"


@query(
    f"""WITH {_BOUNDS} SELECT o_orderkey, low <= 25.0 AND 20.0 <= high AS overlaps, (high - low) / 2 AS half, printf('%.4f +/- %.4f', low, (high - low) / 2) AS said, round(100 * (high - (low + 1)) / (low + 1), 6) AS change,
  CASE WHEN high - 30 < 0 THEN 'better' WHEN low - 30 > 0 THEN 'worse' ELSE 'not separated' END AS verdict FROM bounds"""
)
def interval_arithmetic(spark, sf_dir):
    low = F.pmod("o_custkey", F.lit(40)).cast("double")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", low.alias("low"), (low + F.pmod("o_orderkey", F.lit(9))).alias("high"))
    low, high = F.col("low"), F.col("high")
    return rows.select(
        "o_orderkey", statistics.overlap(low, high, F.lit(20.0), F.lit(25.0)).alias("overlaps"), statistics.half_width(low, high).alias("half"), statistics.plus_minus(low, low, high).alias("said"),
        F.round(statistics.percent_change(low + 1, high), 6).alias("change"), statistics.verdict(low - 30, high - 30).alias("verdict"),
    )


@query("SELECT o_orderkey, 'A-' || strftime(o_orderdate, '%Y%m%d-%H%M') AS name, CAST(o_orderdate AS TIMESTAMP) AS began FROM orders")
def run_times(spark, sf_dir):
    """Names of runs that begin at a time, and the times read from the names."""
    named = table(spark, sf_dir, "orders").select("o_orderkey", runs.run_name(F.lit("A"), F.col("o_orderdate").cast("timestamp")).alias("name"))
    return named.withColumn("began", runs.run_time(F.col("name")).cast("timestamp_ntz"))


@query(
    """SELECT o_orderkey, abs(o_totalprice - 150000) / 150000 < 0.01 AND o_custkey % 4 = 0 AND o_orderkey % 5 > 0 AS ready, CAST(o_custkey // 32 AS BIGINT) AS steps_floor, CAST(ceil(o_custkey / 32.0) AS BIGINT) AS steps_ceil,
  round(o_custkey * 1024.0 * 5 / 3901 / 3600, 6) AS hours, round(o_custkey * 1024.0 * 5 / 3901 / 3600 * 1.89, 6) AS dollars FROM orders"""
)
def mixtures_ready(spark, sf_dir):
    """Whether loaded tokens are near those declared, and what training on so many sequences costs."""
    ready = mixture.verified(F.col("o_totalprice"), F.lit(150000), F.pmod("o_custkey", F.lit(4)), F.pmod("o_orderkey", F.lit(5)))
    cost = mixture.training_cost(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ready.alias("ready"), cost["steps_floor"].cast("long").alias("steps_floor"), cost["steps_ceil"].cast("long").alias("steps_ceil"), F.round(cost["hours"], 6).alias("hours"), F.round(cost["dollars"], 6).alias("dollars"))


# --- plans of mixtures --------------------------------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT o_orderkey AS pos, 'f' || (o_custkey % 50) AS path, CASE o_custkey % 50 % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'fill' ELSE 'unpaired' END AS take, CASE WHEN o_custkey % 50 % 3 = 1 THEN o_custkey % 50 * 100 END AS budget FROM orders)
SELECT path, min(take) AS take, CAST(min(budget) AS BIGINT) AS budget, min(pos) AS pos FROM n GROUP BY path"""
)
def plan_dedup(spark, sf_dir):
    """A recipe that names every file many times, in each way that a file can be taken."""
    f = F.pmod("o_custkey", F.lit(50))
    phrase = F.when(f % 3 == 0, F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "tout").otherwise("cote francais")).when(f % 3 == 1, "completer").otherwise("sans la part appariee de b")
    return mixture.plan(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("f"), f).alias("fichier"), phrase.alias("prendre"), (f * 100).cast("long").alias("tokens")))


_COPIED = "copied AS (SELECT conv_id AS turn_id, unnest(range(len(m))) AS \"at\", unnest(m) AS text FROM (SELECT conv_id, list(CASE WHEN conv_id % 9 = turn THEN 'Avant. ' || (SELECT text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)) ELSE text END ORDER BY turn) AS m FROM conversations GROUP BY conv_id))"


@query(
    f"""WITH {_COPIED}, held AS (SELECT DISTINCT {key_sql('text')} AS k FROM benchmark), f AS (SELECT turn_id, "at", CASE WHEN EXISTS (SELECT 1 FROM held WHERE k = {key_sql('text')}) THEN 'equal' WHEN EXISTS (SELECT 1 FROM held WHERE length(k) >= 40 AND contains({key_sql('text')}, k)) THEN 'contained' END AS leak FROM copied)
SELECT turn_id, CAST("at" AS INTEGER) AS "at", leak FROM f WHERE leak IS NOT NULL QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY "at") = 1"""
)
def turn_leaks(spark, sf_dir):
    """Turns of which every ninth has a held-out text put into one of its messages."""
    b = table(spark, sf_dir, "benchmark")
    first = b.groupBy().agg(F.min_by("text", "item_id").alias("held_text"))
    c = table(spark, sf_dir, "conversations").join(F.broadcast(first), how="cross")  # one row on one side
    text = F.when(F.pmod("conv_id", F.lit(9)) == F.col("turn"), F.concat(F.lit("Avant. "), "held_text")).otherwise(F.col("text"))
    folded = c.groupBy(F.col("conv_id").alias("turn_id")).agg(F.array_sort(F.collect_list(F.struct("turn", text.alias("content")))).alias("messages"))
    rows = folded.select("turn_id", F.lit("t").alias("task"), F.lit("s").alias("source"), "messages")
    held = leaks.held_out_keys(b.select(F.lit("c").alias("capacite"), "text"))
    return leaks.first_leak_of_turn(rows, held).select("turn_id", "at", "leak")


@query(f"WITH {CORPUS} SELECT pos, file, text, part AS lang FROM corpus")
def json_lines(spark, sf_dir):
    """Documents written as JSON lines and read again; a line says which document it is, and the order of each file's lines is held against theirs."""
    from pyspark.sql import Window

    path = folder(spark, "json-lines")
    rows = corpus(spark, sf_dir).select("file", "pos", "part", "text", "tokens").sortWithinPartitions("pos")
    rows.select(F.to_json(F.struct("text", "tokens", F.col("file").alias("registre"), F.col("pos").alias("doc"), "part")).alias("value")).write.text(path)
    read = tables.split_lines(spark, path, f"{tables.MIXTURE_DOC}, doc long, part string")
    before = F.lag("doc").over(Window.partitionBy("file").orderBy("pos"))
    if not read.select("doc", before.alias("before")).filter("before > doc").isEmpty():
        raise ValueError("the lines' places are not in their file's order")
    return read.select(F.col("doc").alias("pos"), F.col("registre").alias("file"), "text", F.col("part").alias("lang"))


@query(f"WITH {CORPUS} SELECT md5(text) AS digest, 'part ' || part AS part, file AS source FROM corpus WHERE tokens > 3")
def frozen_mixture(spark, sf_dir):
    """A mixture frozen under its content's name and read through its pointer."""
    out = folder(spark, "frozen")
    rows = corpus(spark, sf_dir).withColumn("kept", F.col("tokens") > 3).withColumn("dropped", F.lit(False)).withColumn("reached", F.col("kept")).withColumn("leak", F.lit(None).cast("string")).withColumn("budget", F.lit(None).cast("long"))
    rows = rows.withColumn("part_", F.concat(F.lit("part "), "part"))
    labels = {}
    card = mixture.freeze(written(rows.withColumn("file", F.concat_ws("|", "file", "part")), "loaded"), "A", out, ["pos"], labels, {}, {"quoi": "test"})
    read = spark.read.parquet(f"{mixture.frozen_card(spark, 'A', out)['uri']}/data")
    if read.count() != card["documents"] or mixture.frozen(spark, "A", out)[0].columns != ["text"]:
        raise ValueError("the card differs from its data")
    return read.select(F.md5("text").alias("digest"), F.concat(F.lit("part "), F.split_part("source", F.lit("|"), F.lit(2))).alias("part"), F.split_part("source", F.lit("|"), F.lit(1)).alias("source"))


_DIGESTS = "r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS place, sha256(text) AS d FROM documents), b AS (SELECT place // 65536 AS b, sha256(string_agg(d, '' ORDER BY place)) AS d FROM r GROUP BY 1), c AS (SELECT b // 65536 AS c, sha256(string_agg(d, '' ORDER BY b)) AS d FROM b GROUP BY 1)"


@query(f"WITH {_DIGESTS} SELECT substr(sha256(string_agg(d, '' ORDER BY c)), 1, 12) AS fingerprint FROM c")
def block_fingerprint(spark, sf_dir):
    return spark.createDataFrame([(mixture.block_fingerprint(corpus(spark, sf_dir), ["pos"]),)], "fingerprint string")


@query("SELECT 'k=' || (o_orderkey % 7) AS key, sha256(string_agg('order ' || o_orderkey || chr(10), '' ORDER BY o_orderkey)) AS sha256, CASE o_orderkey % 7 WHEN 3 THEN false WHEN 4 THEN NULL ELSE true END AS matches FROM orders GROUP BY o_orderkey % 7")
def object_digests(spark, sf_dir):
    """Files in a folder, hashed on the executors and held against wanted digests: one differs, one is absent."""
    root = folder(spark, "objects")
    rows = table(spark, sf_dir, "orders").select(F.pmod("o_orderkey", F.lit(7)).alias("k"), "o_orderkey").repartition("k").sortWithinPartitions("k", "o_orderkey")
    rows.select("k", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("value")).write.partitionBy("k").text(root)
    found = files.digests(spark, root, "*.txt")
    wanted = found.select("key", F.when(F.col("key").startswith("k=3/"), F.lit("other")).otherwise(F.col("sha256")).alias("sha256"))
    compared = files.matches(wanted, found.filter(~F.col("key").startswith("k=4/")))
    return found.select("key", "sha256").join(compared.select("key", "matches"), "key").withColumn("key", F.split_part("key", F.lit("/"), F.lit(1)))


@query(
    f"""WITH {CORPUS}, w AS (SELECT pos, {tokens_sql('text')} AS words FROM corpus), s AS (SELECT pos, words, coalesce(sum(len(words) + 1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM w),
t AS (SELECT begins + i AS place, CASE WHEN i = len(words) THEN '</s>' ELSE words[i + 1] END AS word FROM (SELECT begins, words, unnest(range(len(words) + 1)) AS i FROM s)), u AS (SELECT *, max(place) OVER () AS last FROM t)
SELECT CAST(count(*) // 2048 AS BIGINT) AS sequences FROM u WHERE place < last"""
)
def packed_cache(spark, sf_dir):
    """Packed once, and read the second time."""
    docs = corpus(spark, sf_dir).withColumn("ids", T.tokens(F.col("text"))).select("pos", "ids")
    out = folder(spark, "packed")
    packing.cached(docs, F.col("ids"), ["pos"], "</s>", 2048, out, "mark")
    return packing.cached(docs.limit(0), F.col("ids"), ["pos"], "</s>", 2048, out, "mark").agg(F.count("*").alias("sequences"))


# --- reports over points ------------------------------------------------------------------------------------------------

_IDS = "CASE WHEN step % 700 = 0 THEN ['a'] ELSE ['a', 'b'] END"
_NOTE = "CASE WHEN arm = 'base' THEN 'juste' WHEN step = 900 THEN 'piege' WHEN step % 400 = 0 THEN 'faux' WHEN step % 300 = 0 THEN 'ambigu' ELSE 'juste' END"


def point_rows(spark, sf_dir) -> DataFrame:
    """The curves' points as point files have them, with facts; measured without values of single texts."""
    p = points(spark, sf_dir).withColumn("budget", F.when(F.pmod("step", F.lit(500)) == 0, 128).otherwise(320)).withColumn("budget", F.when(F.col("arm") == "base", 320).otherwise(F.col("budget")))
    ids = F.when((F.pmod("step", F.lit(700)) == 0) & (F.col("arm") != "base"), F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    note = F.expr(_NOTE)
    measure = lambda c: F.struct(F.col(c).alias("bits_par_caractere"))
    kind = spark.createDataFrame([], tables.POINT).schema["mesures"].dataType.simpleString()
    columns = ("moore_humain", *curves.SHOULD_HOLD)
    mesures = F.from_json(F.to_json(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*map(measure, columns)))), kind)
    faits = F.transform(ids, lambda i: F.struct(i.alias("id"), F.lit("d").alias("domaine"), note.alias("note"), F.lit("").alias("reponse"), F.lit(True).alias("complet")))
    path = F.when(F.col("arm") == "base", "").otherwise(F.concat(F.lit("/content/cpt/"), "arm", F.lit("-20260831-1024/"), "point"))
    stem = F.concat_ws("-", "arm", "point")
    # a few dozen rows that many reports read
    return written(p.select(stem.alias("stem"), "point", path.alias("chemin"), mesures.alias("mesures"), faits.alias("faits"), F.lit(None).cast("struct<juste:int,piege:int,ambigu:int,faux:int>").alias("faits_compte"), F.col("budget").alias("budget_faits"), "arm", "step"), "points")


def answer_rows(spark, sf_dir) -> DataFrame:
    """Replies as answers to held-out questions; some points have none."""
    r = replies(spark, sf_dir).filter("conv_id % 12 <> 5")
    arm = F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("conv_id", F.lit(4)) + 1).cast("int"))
    return r.select(arm.alias("arm"), ((F.pmod("conv_id", F.lit(12)) + 1) * 100).cast("string").alias("step"), "obtenu")


_OPENING = f"array_to_string(({tokens_sql('obtenu')})[1:2], ' ')"
_JUDGED = f"""{REPLIES}, answered AS (SELECT (['A', 'B', 'C', 'D'])[conv_id % 4 + 1] AS arm, (conv_id % 12 + 1) * 100 AS step, obtenu FROM replies WHERE conv_id % 12 <> 5),
o AS (SELECT arm, step, max(n) AS big, sum(n) AS n FROM (SELECT arm, step, {_OPENING} AS k, count(*) AS n FROM answered GROUP BY ALL) GROUP BY arm, step),
r AS (SELECT arm, step, max(n) AS big FROM (SELECT arm, step, obtenu AS k, count(*) AS n FROM answered GROUP BY ALL) GROUP BY arm, step),
said AS (SELECT arm, step, NOT (r.big < 2) OR NOT (o.big * 2 <= o.n) AS collapsed FROM o JOIN r USING (arm, step))"""


def _kept_sql(answers: bool) -> str:
    said = f", {_JUDGED}" if answers else ", said AS (SELECT arm, step, false AS collapsed FROM points WHERE false)"
    return f"""{POINTS}{said}, noted AS (SELECT *, {_IDS} AS ids, {_NOTE} AS note, CASE WHEN step % 500 = 0 THEN 128 ELSE 320 END AS budget FROM points WHERE arm <> 'base'), base AS (SELECT * FROM points WHERE arm = 'base'),
seen AS (SELECT p.*, coalesce(lag(p.moore_humain) OVER (PARTITION BY p.arm ORDER BY p.step), b.moore_humain) AS previous, budget = 320 AND len(ids) = 2 AS comparable, b.anglais AS b1, b.francais AS b2, b.code AS b3, b.maths AS b4 FROM noted p, base b),
marked AS (SELECT *, moore_humain >= previous OR comparable AND note = 'piege' OR (anglais - b1) / b1 > 0.03 OR (francais - b2) / b2 > 0.03 OR (code - b3) / b3 > 0.03 OR (maths - b4) / b4 > 0.03 AS signal FROM seen),
cuts AS (SELECT m.*, min(CASE WHEN signal THEN m.step END) OVER (PARTITION BY m.arm) AS cut, coalesce(collapsed, false) AS collapsed, collapsed IS NULL AS unsaid FROM marked m LEFT JOIN said ON said.arm = m.arm AND said.step = m.step),
judged AS (SELECT *, (cut IS NULL OR step < cut) AND NOT collapsed AS eligible FROM cuts),
kept AS (SELECT *, eligible AND row_number() OVER (PARTITION BY arm, eligible ORDER BY moore_humain, step) = 1 AS kept FROM judged)"""


@query(
    f"""WITH {_kept_sql(False)} SELECT arm, step, comparable, signal, cut, eligible, kept, CASE WHEN note = 'faux' THEN array_to_string(ids, ',') ELSE '' END AS forgotten, CASE WHEN note = 'ambigu' THEN array_to_string(ids, ',') ELSE '' END AS ambiguous FROM kept"""
)
def keep_points(spark, sf_dir):
    rows = reports.keepable(point_rows(spark, sf_dir))
    return rows.select("arm", "step", "comparable", "signal", "cut", "eligible", "kept", F.array_join("forgotten", ",").alias("forgotten"), F.array_join("ambiguous", ",").alias("ambiguous"))


@query(f"WITH {_kept_sql(True)} SELECT arm, step, collapsed, unsaid AS unchecked, (cut IS NULL OR step < cut) AND collapsed AS skipped, eligible, kept FROM kept")
def keep_answered_points(spark, sf_dir):
    """With answers: points that have collapsed are passed over, those without answers unchecked."""
    rows = reports.keepable(point_rows(spark, sf_dir), answer_rows(spark, sf_dir))
    return rows.select("arm", "step", F.col("collapsed").isNotNull().alias("collapsed"), "unchecked", "skipped", "eligible", "kept")


@query(f"WITH {_kept_sql(True)} SELECT arm, step, kept FROM kept QUALIFY row_number() OVER (PARTITION BY arm ORDER BY kept DESC, step DESC) = 1")
def shown_points(spark, sf_dir):
    return curves.shown(reports.keepable(point_rows(spark, sf_dir), answer_rows(spark, sf_dir))).select("arm", "step", "kept")


@query(f"WITH {_kept_sql(False)}, code AS (SELECT CASE WHEN bool_and(keeps) THEN 0 ELSE 1 END AS code FROM (SELECT arm, bool_or(kept) AS keeps FROM kept GROUP BY arm)) SELECT c.code, k.arm, k.step FROM kept k, code c WHERE k.kept")
def compare_arms(spark, sf_dir):
    """The exit code of a comparison beside the points that it keeps."""
    code, rows = reports.compare(point_rows(spark, sf_dir))
    return rows.select(F.lit(code).alias("code"), "arm", "step")


@query(f"WITH {POINTS} SELECT capability, CASE WHEN arm = 'base' THEN point ELSE arm || '/' || point END AS name, value FROM points UNPIVOT (value FOR capability IN (moore_humain, anglais, francais, code, maths))")
def bpc_matrix(spark, sf_dir):
    wide = reports.bpc_table(point_rows(spark, sf_dir).drop("arm", "step"))
    return wide.unpivot(["capability"], [c for c in wide.columns if c != "capability"], "name", "value").filter("value IS NOT NULL")


_FLIPPED = "CASE WHEN step % 200 = 0 AND arm <> 'base' THEN 1 END"


@query(f"WITH {POINTS} SELECT arm, step, CASE WHEN {_FLIPPED} = 1 THEN 1 ELSE 2 - CAST(step % 700 = 0 AND arm <> 'base' AS INTEGER) END AS facts, CASE WHEN {_FLIPPED} = 1 THEN 1 END AS right_ones, CASE WHEN {_FLIPPED} = 1 THEN 64 WHEN step % 500 = 0 AND arm <> 'base' THEN 128 ELSE 320 END AS budget FROM points")
def replaced_facts(spark, sf_dir):
    """Points whose facts were asked anew have the new ones, counted; the others keep theirs."""
    p = point_rows(spark, sf_dir)
    again = p.filter("step % 200 = 0 AND arm <> 'base'").select("stem", F.lit("c").alias("id"), F.lit("d").alias("domaine"), F.lit("juste").alias("note"), F.lit("x").alias("reponse"), F.lit(True).alias("complet"))
    out = reports.with_facts(p.drop("point").withColumnRenamed("stem", "point"), again.withColumnRenamed("stem", "point"), 64)
    return out.select("arm", "step", F.size("faits").alias("facts"), F.col("faits_compte.juste").alias("right_ones"), F.col("budget_faits").alias("budget"))


@query(f"WITH {POINTS} SELECT arm || '-' || point AS stem, capability, value FROM points UNPIVOT (value FOR capability IN (moore_humain, anglais, francais, code, maths))")
def point_files(spark, sf_dir):
    """Points written as one JSON document each and read again."""
    path = folder(spark, "points")
    for r in point_rows(spark, sf_dir).select("stem", F.to_json(F.struct("point", "chemin", "mesures", "faits", "budget_faits")).alias("json")).collect():  # a few dozen points
        files.write_text(spark, f"{path}/{r['stem']}.json", r["json"])
    return tables.measures(tables.points(spark, f"{path}/*.json")).select("stem", "capability", F.col("bits_par_caractere").alias("value"))


# --- answers ------------------------------------------------------------------------------------------------------------

_QUESTIONS = f"""q AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS obtenu FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
current AS (SELECT DISTINCT array_to_string(list_sort({words_sql('question')}), ' ') AS bag FROM q WHERE conv_id % 2 = 0)"""


@query(
    f"""WITH {_QUESTIONS} SELECT conv_id, turn, (['P2', 'base', '?'])[conv_id % 3 + 1] AS arm, CASE WHEN turn % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE 'point ' || turn END AS step FROM q
WHERE array_to_string(list_sort({words_sql('question')}), ' ') IN (SELECT bag FROM current)"""
)
def counted_answers(spark, sf_dir):
    """Answers whose question is still asked, its words in another order."""
    q = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("prompt").alias("question"), F.col("reponse").alias("obtenu"))
    turned = F.array_join(F.reverse(F.split("question", " ")), " ")
    pick = F.element_at(F.array(F.lit("P2@checkpoint-9"), F.lit("base"), F.lit("")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    point = F.when(F.pmod("turn", F.lit(2)) == 0, F.concat(F.lit("P2-checkpoint-"), F.col("conv_id").cast("string"))).otherwise(F.concat(F.lit("point "), F.col("turn").cast("string")))
    answers = q.select("conv_id", "turn", pick.alias("depart"), point.alias("point"), "obtenu", turned.alias("question"))
    return collapse.counted_answers(answers, q.filter("conv_id % 2 = 0").select("question")).select("conv_id", "turn", "arm", "step")


@query(f"WITH {_SCORED}, known AS (SELECT DISTINCT id || '-' || conv_id % 3 AS item FROM v WHERE verdict = 'juste' AND grp < 6) SELECT 'x' || grp AS arm, string_agg(DISTINCT id || '-' || conv_id % 3, ',' ORDER BY id || '-' || conv_id % 3) AS lost FROM v WHERE verdict = 'piege' AND id || '-' || conv_id % 3 IN (SELECT item FROM known) GROUP BY grp")
def known_facts_lost(spark, sf_dir):
    """Facts that the base has right and a point answers otherwise."""
    v = _scored(spark, sf_dir).select(F.concat(F.lit("x"), "grp").alias("arm"), "grp", F.concat("id", F.lit("-"), F.pmod("conv_id", F.lit(3))).alias("id"), F.col("verdict").alias("note")).withColumn("point", F.lit("p"))
    return curves.lost_facts(v.filter("grp < 6"), v).select("arm", F.array_join("lost_ids", ",").alias("lost"))


@query(f"""WITH {TURNS}, k AS (SELECT b.item_id, {key_sql('b.text')} AS k FROM benchmark b), d AS (SELECT doc_id, {key_sql('text')} AS k FROM documents)
SELECT doc_id, 'contained' AS how, md5(k.k) AS held FROM d JOIN (SELECT DISTINCT k FROM k WHERE length(k) >= 40) k ON contains(d.k, k.k) AND d.k <> k.k UNION ALL SELECT doc_id, 'equal', md5(d.k) FROM d WHERE d.k IN (SELECT k FROM k)""")
def inspected_keys(spark, sf_dir):
    """The table function over relaxed keys, in a lateral join."""
    keys = [r[0] for r in leaks.held_out_keys(table(spark, sf_dir, "benchmark").select(F.lit("c").alias("capacite"), "text")).select("held_key").collect()]  # the function travels with its keys
    name = f"inspect_{uuid.uuid4().hex}"
    spark.udtf.register(name, leaks.inspector(keys))
    table(spark, sf_dir, "documents").select("doc_id", T.key(F.col("text")).alias("relaxed")).createOrReplaceTempView(f"v_{name}")
    return spark.sql(f"SELECT doc_id, how, md5(held_key) AS held FROM v_{name}, LATERAL {name}(relaxed)")


# --- turns and runs -----------------------------------------------------------------------------------------------------


@query(f"WITH {TURNS} SELECT turn_id FROM turns WHERE split = 'val' AND starts_with(variant, 'mos') AND task = 'expliquer_proverbe'")
def question_candidates(spark, sf_dir):
    return turns.question_candidates(conversations(spark, sf_dir)).select("turn_id")


@query(
    f"""WITH {TURNS}, c AS (SELECT count(*) FILTER (split = 'train' AND list_contains({_names(turns.VARIANTS)}, variant)) AS train, count(*) FILTER (split = 'val' AND list_contains({_names(turns.VARIANTS)}, variant)) AS val,
  count(DISTINCT variant) FILTER (NOT list_contains({_names((*turns.VARIANTS, *turns.LEFT_OUT))}, variant)) AS unlisted FROM turns) SELECT train, val, CAST(0 AS BIGINT) AS leaks, unlisted, 'no run for arm Z' AS start_missing, false AS ready FROM c"""
)
def tuning_ready(spark, sf_dir):
    t = conversations(spark, sf_dir)
    return turns.ready(t, t.limit(0), runs.start_missing(_listing(spark, sf_dir), "Z@checkpoint-3"))


@query(f"WITH {LOG} SELECT run, pas, eval_loss FROM log WHERE eval_loss IS NOT NULL AND pas <> (SELECT max(pas) FROM log WHERE eval_loss IS NOT NULL)")
def evaluations_in_order(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("epoque", F.col("run"))
    last = e.filter("eval_loss IS NOT NULL").agg(F.max("pas")).first()[0]
    return curves.evaluations(e, last).select(F.col("epoque").alias("run"), "pas", "eval_loss")


@query("SELECT DISTINCT 'run-' || (user_id % 8) AS run FROM events WHERE event_type = 'error'")
def run_names(spark, sf_dir):
    kept = _listing(spark, sf_dir).unionAll(spark.createDataFrame([("other/x",), ("run-loose",)], "key string"))
    return runs.run_names(kept, "run-")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'b' || o_custkey % 5 END AS bucket, CASE o_orderkey % 3 WHEN 0 THEN 'x/' || o_custkey ELSE '' END AS prefix FROM orders")
def split_uris(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    bucket = F.concat(F.lit("b"), F.pmod(c, F.lit(5)).cast("string"))
    uri = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("s3://"), bucket, F.lit("/x/"), c.cast("string"))).when(F.pmod(k, F.lit(3)) == 1, F.concat(F.lit("s3a://"), bucket)).otherwise(F.lit("/local/x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", runs.split_uri(uri)["bucket"].alias("bucket"), runs.split_uri(uri)["prefix"].alias("prefix"))


@query(f"WITH {_LISTED}, l AS (SELECT *, max(step) OVER (PARTITION BY run) AS last FROM listed) SELECT run, name, step, 'stored' AS place FROM l WHERE step = last AND run = (SELECT max(run) FROM l WHERE step = last AND run <> 'run-7')")
def resolved_run(spark, sf_dir):
    """The newest run whose last checkpoint has its state: that of the last run by name has not."""
    keys = _listing(spark, sf_dir)
    state = keys.filter("key NOT LIKE 'run-7/%'").select(F.replace("key", F.lit("adapter.bin"), F.lit(runs.REQUIRED_TO_RESUME)).alias("key"))
    return runs.resolved(keys.unionAll(state), "run-", keys.limit(0))


_SAVED = "o AS (SELECT run, step, row_number() OVER (PARTITION BY run, step // 97 ORDER BY step) = 1 AS opens, lead(step) OVER (PARTITION BY run ORDER BY step) AS nxt FROM listed), actions AS (SELECT run, step, CASE WHEN nxt IS NULL THEN NULL WHEN opens THEN 'prune' ELSE 'delete' END AS action FROM o)"


@query(f"WITH {_LISTED}, {_SAVED}, files AS (SELECT unnest(['adapter.bin', 'optimizer.pt']) AS f) SELECT run || '/checkpoint-' || step || '/' || f AS key, action FROM actions, files WHERE action = 'delete' OR action = 'prune' AND f = 'optimizer.pt'")
def deleted_keys(spark, sf_dir):
    keys = _listing(spark, sf_dir).distinct()
    keys = keys.unionAll(keys.select(F.replace("key", F.lit("adapter.bin"), F.lit("optimizer.pt")).alias("key")))
    actions = runs.retention(runs.checkpoints(keys).select("run", "step"), 97, keep_all=False)
    return runs.deletions(keys, actions)


@query(f"WITH {_LISTED}, {_SAVED} SELECT l.run, l.step, o.opens, lag(l.step) OVER (PARTITION BY l.run ORDER BY l.step) AS previous FROM listed l JOIN o ON o.run = l.run AND o.step = l.step")
def retention_stream(spark, sf_dir):
    """The saves as a stream: the state's decisions are those of the batch plan."""
    path, out = folder(spark, "saves"), folder(spark, "retained")
    runs.checkpoints(_listing(spark, sf_dir)).select("run", "step").coalesce(1).write.json(path)
    stream = spark.readStream.schema("run string, step long").json(path)
    logs.append_log(logs.retention(stream, 97, keep_all=False), out, folder(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).select("run", "step", "opens", "previous")


# --- resamples ----------------------------------------------------------------------------------------------------------

_DRAWN = "drawn AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY {by}) AS n FROM sums)"


def _resampled_sql(texts: str, by: str, value: str, n: int) -> str:
    """Values of resamples of ``texts`` (by, p, n and what ``value`` sums), drawn as ``congruential_in_parts`` does."""
    return f"""d AS (SELECT DISTINCT {by}, n, draw FROM {texts}, range({n}) r(draw)), k AS (SELECT {by}, draw, unnest(range(n)) AS slot, n FROM d),
sums AS (SELECT {by}, draw, {value} AS x FROM (SELECT {by}, draw, (7919 * draw + 104729 * slot + draw * slot) % n AS p FROM k) JOIN {texts} USING ({by}, p) GROUP BY {by}, draw), {_DRAWN.format(by=by)}"""


_BITS = "sum({nll}) / ln(2) / sum(chars)"
_TEXTS = "t AS (SELECT source, nll, nll * (1 + (pos % 7) / 100.0) AS after, chars, row_number() OVER (PARTITION BY source ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM per_text)"


def _interval_sql(value: str) -> str:
    return f"""WITH {PER_TEXT}, {_TEXTS}, {_resampled_sql('t', 'source', value, 2000)}, whole AS (SELECT source, {value} AS value FROM t GROUP BY source)
SELECT source, round(value, 6) AS value, round(max(x) FILTER (r = 50), 6) AS low, round(max(x) FILTER (r = 1950), 6) AS high FROM drawn JOIN whole USING (source) GROUP BY source, value"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(_interval_sql(_BITS.format(nll="nll")))
def interval_bounds(spark, sf_dir):
    """The reported intervals' rule with draws that SQL can make."""
    return _rounded(statistics.intervals(per_text(spark, sf_dir), ["source"], seed=0, draws=statistics.congruential_in_parts), "value", "low", "high")


@query(_interval_sql("(sum(after) - sum(nll)) / ln(2) / sum(chars)"))
def paired_bounds(spark, sf_dir):
    rows = per_text(spark, sf_dir)
    after = rows.withColumn("nll", F.col("nll") * (1 + F.pmod("pos", F.lit(7)) / 100))
    return _rounded(statistics.differences(rows, after, ["source"], seed=0, draws=statistics.congruential_in_parts), "value", "low", "high")


@query(
    f"""WITH {PER_TEXT}, t AS (SELECT lang AS capability, source AS stage, nll, nll * 1.03 AS other, chars FROM per_text), w AS (SELECT capability, stage, (sum(other) - sum(nll)) / ln(2) / sum(chars) AS value FROM t GROUP BY capability, stage)
SELECT capability, stage, 'C' AS arm, round(value, 6) AS value, true AS inside FROM w"""
)
def transfer_of_arms(spark, sf_dir):
    """An arm minus the reference by capability and stage: where every text is a like share worse, so is the whole, and its interval has it inside."""
    rows = per_text(spark, sf_dir).select(F.col("lang").alias("capability"), F.col("source").alias("stage"), "pos", "nll", "chars")
    both = rows.withColumn("arm", F.lit("P2")).unionByName(rows.withColumn("arm", F.lit("C")).withColumn("nll", F.col("nll") * 1.03))
    found = curves.transfer(both)
    return found.select("capability", "stage", "arm", F.round("value", 6).alias("value"), ((F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high"))).alias("inside"))


# --- translation --------------------------------------------------------------------------------------------------------

_MARKS = "['!', '\"', '#', '$', '%', '&', '''', '(', ')', '*', '+', ',', '-', '.', '/', ':', ';', '<', '=', '>', '?', '@', '[', '\\', ']', '^', '_', '`', '{', '|', '}', '~']"


def _words_apart_sql(tokens: str) -> str:
    return f"flatten(list_transform({tokens}, lambda w: CASE WHEN length(w) > 1 AND list_contains({_MARKS}, w[-1]) THEN [w[:-2], w[-1]] WHEN length(w) > 1 AND list_contains({_MARKS}, w[1]) THEN [w[1], w[2:]] ELSE [w] END))"


def _chrf_sql(pairs: str, by: str) -> str:
    """Sums of n-grams by ``by`` and order of ``pairs`` (by, id, h, r), and the scores made of them."""
    return f"""sides AS (SELECT {by}, id, 0 AS side, h AS s FROM {pairs} UNION ALL SELECT {by}, id, 1, r FROM {pairs}),
bare AS (SELECT {by}, id, side, regexp_replace(s, '\\s+', '', 'g') AS c, {_words_apart_sql(tokens_sql('s'))} AS w FROM sides),
grams AS (SELECT {by}, id, side, n, substr(c, i, n) AS g FROM (SELECT {by}, id, side, c, n, unnest(range(1, length(c) - n + 2)) AS i FROM bare, range(1, 7) o(n))
  UNION ALL SELECT {by}, id, side, 6 + n, array_to_string(w[i : i + n - 1], chr(0)) FROM (SELECT {by}, id, side, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bare, range(1, 3) o(n))),
counts AS (SELECT {by}, id, n, g, count(*) FILTER (side = 0) AS h, count(*) FILTER (side = 1) AS r FROM grams GROUP BY ALL),
orders_ AS (SELECT {by}, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM counts GROUP BY {by}, n),
means AS (SELECT {by}, coalesce(avg(m / h) FILTER (h > 0 AND r > 0), 0) AS p, coalesce(avg(m / r) FILTER (h > 0 AND r > 0), 0) AS q FROM orders_ GROUP BY {by})"""


@query(
    f"""WITH pairs AS (SELECT a.conv_id % 5 AS grp, a.conv_id || '-' || a.turn AS id, b.text AS h, a.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
{_chrf_sql('pairs', 'grp')} SELECT grp, round(100 * CASE WHEN p + q > 0 THEN 5 * p * q / (4 * p + q) ELSE 0 END, 2) AS chrf FROM means"""
)
def chrf_corpus(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select(F.pmod("conv_id", F.lit(5)).alias("grp"), F.col("reponse").alias("hypothesis"), F.col("prompt").alias("reference"))
    return chrf.corpus_score(rows, ["grp"], word_order=2)


@query("SELECT DISTINCT name FROM (SELECT unnest(['copy', 'reply', 'reply', 'turned']) AS name) WHERE (SELECT count(*) FROM conversations) > 0")
def compared_names(spark, sf_dir):
    """The names that any comparison asks for."""
    pairs = spark.createDataFrame([("copy", "reply"), ("reply", "turned")], "a string, b string")
    there = table(spark, sf_dir, "conversations").limit(1).select(F.lit(1).alias("one"))
    return pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(F.broadcast(there), how="cross").select("name")  # one row on one side


@query("SELECT DISTINCT CAST(role = 'user' AS VARCHAR) AS direction, true AS same_is_zero, true AS copy_wins FROM conversations")
def chrf_paired(spark, sf_dir):
    """Paired resamples of whole scores: a system against itself has no difference, and copies beat the texts turned round."""
    c = table(spark, sf_dir, "conversations").select((F.col("role") == "user").cast("string").alias("direction"), F.col("conv_id"), F.col("turn"), "text")
    c = c.groupBy("direction", (F.col("conv_id") * 1000 + F.col("turn")).alias("pos")).agg(F.first("text").alias("text"))
    copy = c.select(F.lit("copy").alias("name"), "direction", "pos", F.col("text").alias("hypothesis"), F.col("text").alias("reference"))
    turned = copy.withColumn("name", F.lit("turned")).withColumn("hypothesis", F.reverse("hypothesis"))
    found = chrf.paired(copy.unionAll(turned), [("copy", "copy"), ("copy", "turned")])
    same, wins = F.col("a") == F.col("b"), F.col("low") > 0
    zero = (F.col("difference") == 0) & (F.col("low") == 0) & (F.col("high") == 0)
    return found.groupBy("direction").agg(F.bool_and(F.when(same, zero)).alias("same_is_zero"), F.bool_and(F.when(~same, wins)).alias("copy_wins"))
