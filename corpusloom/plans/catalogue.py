"""The library's queries over the standard tables, each with SQL for the same rows.

The relations of the library have stand-ins among the standard tables, written once as
Spark functions and once as SQL:

* corpus: ``documents`` with source as file, language as part, words as tokens
* held-out: ``benchmark`` in two capabilities, and all texts of one source
* turns: ``conversations`` folded by conversation
* log and points: ``events`` and ``orders`` as measurements over steps
* facts: a few needles of common words
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chrf, collapse, curves, facts, leaks, mixture, packing, runs, statistics, turns
from ..session import shared_dir
from ..streaming import logs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- stand-ins ---------------------------------------------------------------------------------------------------------

HELD_SOURCE = "src7"
BUDGET = 20_000
SPACE = "[ \\t\\n\\r\\f\\v]"
KEY = r"regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]', '', 'g')"
WORDS = r"regexp_extract_all(replace(lower({0}), 'ß', 'ss'), '[\p{{L}}\p{{Nl}}\p{{No}}]+')"
TOKENS = r"list_filter(regexp_split_to_array({0}, '[\s\v]+'), lambda x: x <> '')"


def key_sql(c: str) -> str:
    return KEY.format(c)


def words_sql(c: str) -> str:
    return WORDS.format(c)


def tokens_sql(c: str) -> str:
    return TOKENS.format(c)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("pos"), F.col("source").alias("file"), F.col("lang").alias("part"), "text", F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))


CORPUS = f"corpus AS (SELECT doc_id AS pos, source AS file, lang AS part, text, CAST(len({tokens_sql('text')}) AS BIGINT) AS tokens FROM documents)"


def held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.when(F.pmod("item_id", F.lit(2)) == 0, "anglais").otherwise("francais").alias("capacite"), "text")
    d = table(spark, sf_dir, "documents").filter(F.col("source") == HELD_SOURCE).select(F.lit("src").alias("capacite"), "text")
    return leaks.held_out_keys(b.unionByName(d))


HELD = f"""held AS (SELECT DISTINCT capacite, {key_sql('text')} AS held_key FROM (
  SELECT CASE WHEN item_id % 2 = 0 THEN 'anglais' ELSE 'francais' END AS capacite, text FROM benchmark
  UNION ALL SELECT 'src', text FROM documents WHERE source = '{HELD_SOURCE}'))"""

ROUTES = {"en": ("anglais", "src"), "fr": ("francais", "src"), "de": ("src",)}
ROUTED = """routed AS (SELECT DISTINCT t.part, h.held_key FROM held h JOIN (VALUES ('en', 'anglais'), ('en', 'src'), ('fr', 'francais'), ('fr', 'src'), ('de', 'src')) t(part, capacite) USING (capacite)
  UNION SELECT '*', held_key FROM held)"""


def guarded(spark: SparkSession, sf_dir: str, everything: bool = False) -> DataFrame:
    docs = corpus(spark, sf_dir).filter(F.col("file") != HELD_SOURCE)
    docs = docs.withColumn("lang", F.col("part")).withColumn("row_id", F.col("pos"))
    docs = docs.withColumn("part", F.lit(leaks.EVERYTHING)) if everything else docs
    return leaks.inspected(docs, leaks.routes(held_out(spark, sf_dir), docs, ROUTES))


def flagged_sql(part: str) -> str:
    return f"""{CORPUS}, {HELD}, {ROUTED}, keyed AS (SELECT *, {key_sql('text')} AS k, {part} AS checked FROM corpus WHERE file <> '{HELD_SOURCE}'),
flagged AS (SELECT pos, file, part, tokens, CASE WHEN EXISTS (SELECT 1 FROM routed r WHERE r.part = checked AND r.held_key = k) THEN 'equal'
  WHEN EXISTS (SELECT 1 FROM routed r WHERE r.part = checked AND length(r.held_key) >= 40 AND contains(k, r.held_key)) THEN 'contained' END AS leak FROM keyed)"""


VARIANT_NAMES = (*turns.VARIANTS, *turns.LEFT_OUT[:1], "autre")
TASKS = ("traduire", "expliquer_proverbe", "titrer", "resumer", None)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    folded = c.groupBy(F.col("conv_id").alias("turn_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.pmod("turn_id", F.lit(n)) + 1).cast("int"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    split = F.when(F.pmod("turn_id", F.lit(10)) == 0, "val").otherwise("train").alias("split")
    return folded.select("turn_id", split, pick(VARIANT_NAMES, 7).alias("variant"), pick(TASKS, 5).alias("task"), F.concat(F.lit("set"), F.pmod("turn_id", F.lit(3))).alias("source"), messages)


def _names(names) -> str:
    return "[" + ", ".join("NULL" if n is None else f"'{n}'" for n in names) + "]"


TURNS = f"""turns AS (SELECT conv_id AS turn_id, CASE WHEN conv_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, ({_names(VARIANT_NAMES)})[conv_id % 7 + 1] AS variant,
  ({_names(TASKS)})[conv_id % 5 + 1] AS task, 'set' || (conv_id % 3) AS source, list({{'role': role, 'content': text}} ORDER BY turn) AS messages FROM conversations GROUP BY conv_id)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("run-"), F.pmod("user_id", F.lit(8))).alias("run"), F.col("event_id").alias("pas"), F.when(F.col("event_type") == F.lit("error"), F.round("value", 4)).alias("eval_loss"))


LOG = "log AS (SELECT 'run-' || (user_id % 8) AS run, event_id AS pas, CASE WHEN event_type = 'error' THEN round(value, 4) END AS eval_loss FROM events)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices by customer group as four arms' curves over 12 steps; group 0 at step 0 is the base."""
    o = table(spark, sf_dir, "orders")
    arm = F.element_at(F.array(*map(F.lit, "ABCD")), (F.pmod("o_custkey", F.lit(4)) + 1).cast("int"))
    step = (F.month("o_orderdate") * 100).cast("long")
    value = lambda k: F.round(F.avg(F.when(F.pmod("o_orderkey", F.lit(k)) != 0, F.col("o_totalprice"))) / 100000, 4)
    rows = o.groupBy(arm.alias("arm"), step.alias("step")).agg(*(value(k).alias(c) for k, c in ((2, "moore_humain"), (3, "anglais"), (4, "francais"), (5, "code"), (6, "maths"))))
    rows = rows.withColumn("point", F.concat(F.lit("checkpoint-"), "step"))
    base = rows.filter("arm = 'A' AND step = 100").withColumn("arm", F.lit("base")).withColumn("point", F.lit("base")).withColumn("step", F.lit(0).cast("long"))
    return rows.unionByName(base)


_MEASURES = ", ".join(f"round(avg(CASE WHEN o_orderkey % {k} <> 0 THEN o_totalprice END) / 100000, 4) AS {c}" for k, c in ((2, "moore_humain"), (3, "anglais"), (4, "francais"), (5, "code"), (6, "maths")))
POINTS = f"""own AS (SELECT (['A', 'B', 'C', 'D'])[o_custkey % 4 + 1] AS arm, CAST(month(o_orderdate) * 100 AS BIGINT) AS step, {_MEASURES} FROM orders GROUP BY 1, 2),
points AS (SELECT *, 'checkpoint-' || step AS point FROM own UNION ALL SELECT * REPLACE ('base' AS arm, CAST(0 AS BIGINT) AS step), 'base' FROM own WHERE arm = 'A' AND step = 100)"""


def with_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    columns = ["moore_humain", *curves.SHOULD_HOLD]
    rows = curves.with_previous(p, p.filter("arm = 'base'"), columns)
    rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("rise", "rise_low", "rise_high")}).withColumn("comparable", F.lit(True)).withColumn("lost_ids", F.array().cast("array<string>"))
    rows = rows.withColumn("marks", curves.marks())
    return rows.withColumn("signal", F.size(F.filter("marks", lambda m: m != curves.NOT_COMPARABLE)) > 0).withColumn("collapsed", F.lit(None).cast("string"))


SIGNALS = f"""{POINTS}, base AS (SELECT * FROM points WHERE arm = 'base'),
prev AS (SELECT p.*, coalesce(lag(p.moore_humain) OVER (PARTITION BY p.arm ORDER BY p.step), b.moore_humain) AS previous, b.anglais AS b1, b.francais AS b2, b.code AS b3, b.maths AS b4
  FROM points p, base b WHERE p.arm <> 'base'),
signals AS (SELECT *, CASE WHEN moore_humain >= previous THEN 1 ELSE 0 END + CASE WHEN (anglais - b1) / b1 > 0.03 THEN 1 ELSE 0 END + CASE WHEN (francais - b2) / b2 > 0.03 THEN 1 ELSE 0 END
  + CASE WHEN (code - b3) / b3 > 0.03 THEN 1 ELSE 0 END + CASE WHEN (maths - b4) / b4 > 0.03 THEN 1 ELSE 0 END AS n_marks FROM prev),
cut AS (SELECT *, min(CASE WHEN n_marks > 0 THEN step END) OVER (PARTITION BY arm) AS cut FROM signals)"""


def needles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("f1", ["the", "that"], ["idiot"]), ("f2", ["eau*"], ["les"]), ("f3", ["der"], None), ("f4", ["moron", "12"], ["and"])], "id string, attendu array<string>, piege array<string>")


NEEDLES = "(VALUES ('f1', ['the', 'that'], ['idiot']), ('f2', ['eau*'], ['les']), ('f3', ['der'], NULL), ('f4', ['moron', '12'], ['and'])) f(id, attendu, piege)"


def contains_sql(needle: str, hay: str) -> str:
    edge = r"\p{L}\p{N}_"
    return f"regexp_matches({hay}, '(^|[^{edge}])' || rtrim({needle}, '*') || CASE WHEN ends_with({needle}, '*') THEN '' ELSE '([^{edge}]|$)' END)"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "assistant")
    return c.select(F.col("conv_id"), F.pmod("conv_id", F.lit(12)).alias("grp"), F.concat(F.lit("f"), F.pmod("turn", F.lit(4)) + 1).alias("id"), F.col("turn").alias("pos"), F.col("text").alias("obtenu"))


REPLIES = "replies AS (SELECT conv_id, conv_id % 12 AS grp, 'f' || (turn % 4 + 1) AS id, turn AS pos, text AS obtenu FROM conversations WHERE role = 'assistant')"


def per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("lang", "source", F.col("doc_id").alias("pos"), (F.col("n_chars") * (1 + F.pmod("doc_id", F.lit(17)) / 10.0)).alias("nll"), F.col("n_chars").alias("chars"), F.size(T.tokens(F.col("text"))).cast("long").alias("tokens"))


PER_TEXT = f"per_text AS (SELECT lang, source, doc_id AS pos, n_chars * (1 + (doc_id % 17) / 10.0) AS nll, n_chars AS chars, CAST(len({tokens_sql('text')}) AS BIGINT) AS tokens FROM documents)"


# --- text functions ----------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {key_sql('text')} AS relaxed FROM documents")
def relaxed_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.key(F.col("text")).alias("relaxed"))


@query(
    f"SELECT doc_id, trim(regexp_replace(translate(text, '{T.CONFUSABLE}', '{T.FOLDED}'), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+', ' ', 'g')) AS cleaned FROM documents"
)
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"))


_FRENCH = "[" + ", ".join(f"'{w}'" for w in T.FRENCH) + "]"


def _share(c: str, lexicon: str) -> str:
    return f"CASE WHEN len({words_sql(c)}) > 0 THEN len(list_filter({words_sql(c)}, lambda w: list_contains({lexicon}, w))) / len({words_sql(c)}) ELSE 0 END"


@query(f"SELECT doc_id, round({_share('text', _FRENCH)}, 6) AS share FROM documents")
def french_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.french_share(F.col("text")), 6).alias("share"))


@query(f"SELECT doc_id, regexp_matches(replace(lower(text), 'ß', 'ss'), '[éèêç]') AS has_letter FROM documents")
def unique_letter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.has_unique_letter(F.col("text"), "éèêç").alias("has_letter"))


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[{T.UNIQUE}]') THEN true WHEN len({words_sql('text')}) = 0 THEN false
  WHEN {_share('text', _FRENCH)} >= 0.15 THEN false ELSE len({words_sql('text')}) >= 2 END AS written FROM documents"""
)
def written_in(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.written_in_moore(F.col("text")).alias("written"))


_LEXICON = ["the", "of", "and", "to", "in", "der", "die", "und", "de", "la", "que", "el"]


@query(f"SELECT doc_id, round({_share('text', _names(_LEXICON))}, 6) AS coverage FROM documents")
def lexicon_coverage(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.lexicon_coverage(F.col("text"), _LEXICON), 6).alias("coverage"))


_OUTSIDE = f"""list_sort(list_filter(list_distinct(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '\\p{{L}}')), lambda c: NOT list_contains({_names(T.ALPHABET)}, c)))"""


@query(f"SELECT doc_id, array_to_string({_OUTSIDE}, '') AS letters, array_to_string(list_filter({_OUTSIDE}, lambda c: NOT contains('{T.BORROWED}', c)), '') AS foreign_ones FROM documents")
def outside_alphabet(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.outside_alphabet(text), "").alias("letters"), F.array_join(T.foreign_letters(text), "").alias("foreign_ones"))


@query(
    f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS q, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
w AS (SELECT conv_id, turn, list_distinct({tokens_sql("replace(lower(q), 'ß', 'ss')")}) AS a, list_distinct({tokens_sql("replace(lower(r), 'ß', 'ss')")}) AS b FROM p)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a), 1), 6) AS echo FROM w"""
)
def echo(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(T.overlap(F.col("prompt"), F.col("reponse")), 6).alias("echo"))


def _pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    a = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    b = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reponse"))
    return a.join(b, ["conv_id", "turn"])


@query(
    f"""WITH p AS (SELECT a.conv_id % 5 AS grp, a.text AS q, b.text AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'),
w AS (SELECT grp, list_distinct({tokens_sql("replace(lower(q), 'ß', 'ss')")}) AS a, list_distinct({tokens_sql("replace(lower(r), 'ß', 'ss')")}) AS b FROM p)
SELECT grp, round(avg(len(list_intersect(a, b)) / greatest(len(a), 1)), 3) AS echo FROM w GROUP BY grp"""
)
def mean_echo(spark, sf_dir):
    rows = _pairs(spark, sf_dir).withColumn("famille", F.lit("conversation_moore")).withColumn("grp", F.pmod("conv_id", F.lit(5)))
    return collapse.mean_echo(rows, ["grp"])


@query(f"SELECT doc_id, array_to_string(list_sort({words_sql('text')}), ' ') AS bag FROM documents")
def bag_of_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.bag_of_words(F.col("text")).alias("bag"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(coalesce(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: trim(x)), lambda x: x <> '')[1], ''), '^["«» ]+', ''), '["«» ]+$', '') AS line FROM documents"""
)
def first_line(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_line(F.col("text")).alias("line"))


# --- leaks -------------------------------------------------------------------------------------------------------------


@query(f"WITH {flagged_sql(chr(39) + '*' + chr(39))} SELECT part AS lang, coalesce(leak, 'clean') AS how, count(*) AS documents FROM flagged GROUP BY 1, 2")
def leak_report(spark, sf_dir):
    return guarded(spark, sf_dir, everything=True).groupBy("lang", F.coalesce("leak", F.lit("clean")).alias("how")).agg(F.count("*").alias("documents"))


@query(f"WITH {flagged_sql('part')} SELECT pos, leak FROM flagged WHERE leak IS NOT NULL")
def leak_routed(spark, sf_dir):
    return guarded(spark, sf_dir).filter("leak IS NOT NULL").select("pos", "leak")


@query(f"WITH {CORPUS}, {HELD} SELECT c.pos FROM corpus c WHERE file <> '{HELD_SOURCE}' AND EXISTS (SELECT 1 FROM held WHERE held_key = {key_sql('c.text')})")
def leak_equal(spark, sf_dir):
    docs = corpus(spark, sf_dir).filter(F.col("file") != HELD_SOURCE).withColumn("held_key", T.key(F.col("text")))
    return docs.join(held_out(spark, sf_dir).select("held_key"), "held_key", "left_semi").select("pos")


@query(f"WITH {HELD}, b AS (SELECT held_key FROM held WHERE capacite <> 'src' AND length(held_key) >= 40) SELECT doc_id AS row_id FROM documents WHERE EXISTS (SELECT 1 FROM b WHERE contains({key_sql('text')}, held_key))")
def leak_contained_minimizers(spark, sf_dir):
    docs = corpus(spark, sf_dir).select(F.col("pos").alias("row_id"), F.lit("*").alias("part"), T.key(F.col("text")).alias("_key"))
    keys = held_out(spark, sf_dir).filter("capacite <> 'src'").select(F.lit("*").alias("part"), "held_key").distinct().filter(F.length("held_key") >= leaks.MIN_CONTAINMENT)
    return leaks.contained(docs, keys, sent_chars=0)


# --- mixtures ----------------------------------------------------------------------------------------------------------

@query(f"WITH {CORPUS} SELECT pos, part FROM corpus WHERE part IS NULL OR part NOT IN ('fr', 'es')")
def witness_filter(spark, sf_dir):
    return mixture.witness(corpus(spark, sf_dir).withColumn("registre", F.col("part")), ["fr", "es"]).select("pos", "part")


@query(f"WITH {CORPUS} SELECT DISTINCT {key_sql('text')} AS key FROM corpus WHERE part <> 'fr'")
def witness_keys(spark, sf_dir):
    return mixture.witness_keys(corpus(spark, sf_dir).withColumn("registre", F.col("part")), ["fr"])


@query(f"WITH {CORPUS}, p AS (SELECT DISTINCT {key_sql('text')} AS k FROM corpus WHERE file = '{HELD_SOURCE}') SELECT pos FROM corpus c WHERE file <> '{HELD_SOURCE}' AND NOT EXISTS (SELECT 1 FROM p WHERE k = {key_sql('c.text')})")
def unpaired_anti(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    paired = mixture.paired_keys(docs.filter(F.col("file") == HELD_SOURCE))
    return docs.filter(F.col("file") != HELD_SOURCE).withColumn("key", T.key(F.col("text"))).join(paired, "key", "left_anti").select("pos")


def _loaded(spark, sf_dir):
    docs = corpus(spark, sf_dir).filter(F.col("file") != HELD_SOURCE)
    sources = docs.select(F.col("file").alias("path")).distinct().withColumn("take", F.lit("fill")).withColumn("budget", F.lit(BUDGET).cast("long"))
    return mixture.loaded(docs, sources, None, leaks.routes(held_out(spark, sf_dir), docs, ROUTES))


_LOADED = f"""{flagged_sql('part')}, b AS (SELECT *, coalesce(sum(CASE WHEN leak IS NULL THEN tokens ELSE 0 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {BUDGET} AS reached FROM flagged)"""


@query(f"WITH {_LOADED} SELECT pos, file, tokens FROM b WHERE reached AND leak IS NULL")
def budget_fill(spark, sf_dir):
    return _loaded(spark, sf_dir).filter("kept").select("pos", "file", "tokens")


_REPORT = f"""SELECT file, count(*) FILTER (reached AND leak IS NULL) AS documents, CAST(coalesce(sum(tokens) FILTER (reached AND leak IS NULL), 0) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS dropped_paired,
  count(*) FILTER (reached AND leak IS NOT NULL) AS leaks, CAST({BUDGET} AS BIGINT) AS budget FROM b GROUP BY file"""


@query(f"WITH {_LOADED} {_REPORT}")
def fill_report(spark, sf_dir):
    return mixture.report(_loaded(spark, sf_dir))


@query(f"WITH {_LOADED}, r AS ({_REPORT}) SELECT CAST(sum(documents) AS BIGINT) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(leaks) AS BIGINT) AS leaks, CAST((sum(tokens) + sum(documents)) // 1024 AS BIGINT) AS sequences FROM r")
def arm_totals(spark, sf_dir):
    r = mixture.report(_loaded(spark, sf_dir)).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("leaks").alias("leaks"))
    return r.withColumn("sequences", mixture.sequence_count(F.col("tokens"), F.col("documents")))


@query(f"WITH {CORPUS} SELECT part AS label, CAST(sum(tokens) AS BIGINT) AS tokens, round(100.0 * sum(tokens) / sum(sum(tokens)) OVER (), 2) AS ratio FROM corpus GROUP BY part")
def share_ratio(spark, sf_dir):
    return mixture.shares(corpus(spark, sf_dir), F.col("part"))


@query("SELECT substr(sha256(string_agg(text, chr(0) ORDER BY doc_id) || chr(0)), 1, 12) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return spark.createDataFrame([(mixture.fingerprint(corpus(spark, sf_dir), ["pos"]),)], "fingerprint string")


@query(
    f"""WITH {CORPUS}, w AS (SELECT pos, {tokens_sql('text')} AS words FROM corpus), s AS (SELECT pos, words, coalesce(sum(len(words) + 1) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM w),
t AS (SELECT begins + i AS place, CASE WHEN i = len(words) THEN '</s>' ELSE words[i + 1] END AS word FROM (SELECT begins, words, unnest(range(len(words) + 1)) AS i FROM s)),
u AS (SELECT *, max(place) OVER () AS last FROM t), q AS (SELECT CAST(place // 512 AS BIGINT) AS sequence, list(word ORDER BY place) AS ws FROM u WHERE place < last GROUP BY 1)
SELECT sequence, sha256(array_to_string(ws, ' ')) AS digest FROM q WHERE len(ws) = 512"""
)
def pack_words(spark, sf_dir):
    docs = corpus(spark, sf_dir)
    rows = packing.packed(docs.withColumn("text", T.tokens(F.col("text"))).select("pos", F.col("text").alias("ids")), F.col("ids"), ["pos"], "</s>", 512)
    return rows.select("sequence", F.sha2(F.array_join("ids", " "), 256).alias("digest"))


# --- answers -----------------------------------------------------------------------------------------------------------

_OPEN = f"array_to_string(({tokens_sql('obtenu')})[1:2], ' ')"


@query(f"WITH {REPLIES}, g AS (SELECT grp, {_OPEN} AS k, count(*) AS n FROM replies GROUP BY 1, 2) SELECT grp, count(*) AS distinct_groups, max(n) AS largest, CAST(sum(n) AS BIGINT) AS answers FROM g GROUP BY grp")
def openings(spark, sf_dir):
    return collapse.openings(replies(spark, sf_dir), ["grp"])


@query(f"WITH {REPLIES}, g AS (SELECT grp, obtenu AS k, count(*) AS n FROM replies GROUP BY 1, 2) SELECT grp, count(*) AS distinct_groups, max(n) AS largest, CAST(sum(n) AS BIGINT) AS answers FROM g GROUP BY grp")
def repeats(spark, sf_dir):
    return collapse.repeats(replies(spark, sf_dir), ["grp"])


@query(
    f"""WITH {REPLIES}, o AS (SELECT grp, max(n) AS big, sum(n) AS n FROM (SELECT grp, {_OPEN} AS k, count(*) AS n FROM replies GROUP BY 1, 2) GROUP BY grp),
r AS (SELECT grp, max(n) AS big FROM (SELECT grp, obtenu AS k, count(*) AS n FROM replies GROUP BY 1, 2) GROUP BY grp)
SELECT grp, r.big < 2 AS answers_each, o.big * 2 <= o.n AS speaks_to_each FROM o JOIN r USING (grp)"""
)
def collapse_verdict(spark, sf_dir):
    return collapse.verdicts(replies(spark, sf_dir), ["grp"]).select("grp", "answers_each", "speaks_to_each")


_HAY = "translate(replace(lower(obtenu), 'ß', 'ss'), '’ʼ‘', '''''''')"
_SCORED = f"""{REPLIES}, s AS (SELECT r.*, len(list_filter(attendu, lambda x: {contains_sql('x', _HAY)})) > 0 AS good, len(list_filter(coalesce(piege, []), lambda x: {contains_sql('x', _HAY)})) > 0 AS bad FROM replies r JOIN {NEEDLES} USING (id)),
v AS (SELECT conv_id, grp, id, pos, CASE WHEN good AND bad THEN 'ambigu' WHEN good THEN 'juste' WHEN bad THEN 'piege' ELSE 'faux' END AS verdict FROM s)"""


def _scored(spark, sf_dir):
    rows = replies(spark, sf_dir).join(F.broadcast(needles(spark)), "id")  # four rows
    return rows.withColumn("verdict", facts.score(F.col("obtenu"), F.col("attendu"), F.col("piege")))


@query(f"WITH {_SCORED} SELECT conv_id, pos, verdict FROM v")
def fact_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("conv_id", "pos", "verdict")


@query(f"WITH {_SCORED} SELECT grp, {', '.join(f'''count(*) FILTER (verdict = '{v}') AS {v}''' for v in facts.VERDICTS)} FROM v GROUP BY grp")
def fact_tally(spark, sf_dir):
    return facts.tally(_scored(spark, sf_dir), ["grp"], "verdict")


_FLAT = "strip_accents(replace(lower({0}), 'ß', 'ss'))"


def present_sql(needle: str) -> str:
    n, hay = _FLAT.format(needle), _FLAT.format("obtenu")
    return f"CASE WHEN regexp_full_match(replace(replace({n}, ' ', ''), '.', ''), '[0-9]+') THEN regexp_matches({hay}, '(^|[^0-9])' || {n} || '([^0-9]|$)') ELSE contains({hay}, {n}) END"


@query(
    f"""WITH {REPLIES}, s AS (SELECT r.conv_id, r.pos, len(list_filter(attendu, lambda x: {present_sql("rtrim(x, '*')")})) > 0 AS good, len(list_filter(coalesce(piege, []), lambda x: {present_sql('x')})) > 0 AS bad
  FROM replies r JOIN {NEEDLES} USING (id))
SELECT conv_id, pos, CASE WHEN good AND bad THEN 'ambigu' WHEN good THEN 'juste' WHEN bad THEN 'piege' ELSE 'faux' END AS verdict FROM s"""
)
def fact_judge(spark, sf_dir):
    plain = F.transform("attendu", lambda x: F.rtrim(x, F.lit("*")))
    rows = replies(spark, sf_dir).join(F.broadcast(needles(spark)), "id").select("conv_id", "pos", F.col("obtenu").alias("answer"), plain.alias("expected"), F.coalesce("piege", F.array().cast("array<string>")).alias("traps"))
    return facts.judged(rows).select("conv_id", "pos", "verdict")


@query(
    f"""WITH {_SCORED}, b AS (SELECT grp, id, pos, conv_id, verdict FROM v), a AS (SELECT min(conv_id) AS conv_id, grp, id FROM v GROUP BY grp, id), base AS (SELECT grp || id AS item, verdict FROM b JOIN a USING (conv_id, grp, id) QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY pos) = 1),
now AS (SELECT grp || id AS item, verdict FROM b QUALIFY row_number() OVER (PARTITION BY grp, id ORDER BY conv_id DESC, pos DESC) = 1)
SELECT item AS id, base.verdict = 'juste' AND now.verdict <> 'juste' AS lost, base.verdict <> 'juste' AND now.verdict = 'juste' AS gained FROM now JOIN base USING (item)"""
)
def flips(spark, sf_dir):
    v = _scored(spark, sf_dir).select(F.concat("grp", "id").alias("item"), "conv_id", "pos", "verdict")
    end = lambda f: v.groupBy("item").agg(f("verdict", F.struct("conv_id", "pos")).alias("note")).select(F.col("item").alias("id"), "note")
    return facts.flips(end(F.min_by), end(F.max_by))


@query(
    f"""WITH {_SCORED}, w AS (SELECT *, CASE WHEN conv_id % 3 = 0 THEN 'faux' ELSE verdict END AS note FROM v)
SELECT conv_id, pos, note, verdict AS new_note, id || ' ' || note || '->' || verdict AS change FROM w WHERE note <> verdict"""
)
def rescore_diff(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("conv_id", "pos", "id", F.when(F.pmod("conv_id", F.lit(3)) == 0, "faux").otherwise(F.col("verdict")).alias("note"), F.col("obtenu").alias("reponse"), F.lit(True).alias("complet"))
    return facts.changed(facts.rescored(rows, needles(spark))).select("conv_id", "pos", "note", "new_note", "change")


# --- statistics --------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {PER_TEXT} SELECT lang, round(sum(CASE WHEN tokens >= 2 THEN nll ELSE 0 END) / ln(2) / sum(CASE WHEN tokens >= 2 THEN chars ELSE 0 END), 4) AS bits_per_character,
  round(exp(sum(CASE WHEN tokens >= 2 THEN nll / 100 ELSE 0 END) / sum(CASE WHEN tokens >= 2 THEN tokens ELSE 0 END)), 3) AS perplexity, CAST(sum(CASE WHEN tokens >= 2 THEN tokens ELSE 0 END) AS BIGINT) AS tokens, CAST(sum(CASE WHEN tokens >= 2 THEN chars ELSE 0 END) AS BIGINT) AS chars FROM per_text GROUP BY lang"""
)
def bpc_ratio(spark, sf_dir):
    rows = per_text(spark, sf_dir)
    low = statistics.measured(rows.withColumn("nll", F.col("nll") / 100), ["lang"]).select("lang", "perplexity")
    return statistics.measured(rows, ["lang"]).drop("perplexity").join(low, "lang")


_DRAWS = 20


@query(
    f"""WITH {PER_TEXT}, t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pos) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM per_text),
d AS (SELECT DISTINCT lang, n, draw FROM t, range({_DRAWS}) r(draw)), s AS (SELECT lang, n, draw, unnest(range(n)) AS slot FROM d), k AS (SELECT lang, draw, (7919 * draw + 104729 * slot + draw * slot) % n AS p FROM s)
SELECT lang, CAST(draw AS INTEGER) AS draw, round(sum(nll) / ln(2) / sum(chars), 6) AS bpc FROM k JOIN t USING (lang, p) GROUP BY lang, draw"""
)
def bootstrap_draws(spark, sf_dir):
    rows = turns.numbered_within(per_text(spark, sf_dir).select("lang", "pos", "nll", "chars"), "lang", "pos").drop("pos").withColumnRenamed("place", "pos")
    sums = statistics.congruential_draws(rows, ["lang"], _DRAWS)
    return sums.groupBy("lang", "draw").agg(F.round(statistics.bits_per_character(F.col("nll"), F.col("chars")), 6).alias("bpc"))


@query()
def bootstrap_intervals(spark, sf_dir):
    return statistics.intervals(per_text(spark, sf_dir), ["source"])


@query()
def paired_differences(spark, sf_dir):
    rows = per_text(spark, sf_dir)
    after = rows.withColumn("nll", F.col("nll") * (1 + F.pmod("pos", F.lit(7)) / 100))
    return statistics.differences(rows, after, ["source"])


# --- curves ------------------------------------------------------------------------------------------------------------


@query(f"WITH {SIGNALS} SELECT arm, step, previous, CAST(n_marks AS INTEGER) AS n_marks FROM signals")
def curve_marks(spark, sf_dir):
    return with_signals(spark, sf_dir).select("arm", "step", F.col("previous_moore_humain").alias("previous"), F.size("marks").alias("n_marks"))


@query(f"WITH {SIGNALS} SELECT arm, step, cut, cut IS NULL OR step < cut AS eligible FROM cut")
def curve_cut(spark, sf_dir):
    return curves.cut_and_best(with_signals(spark, sf_dir)).select("arm", "step", "cut", "eligible")


_KEPT = "kept AS (SELECT arm, step, moore_humain FROM cut WHERE cut IS NULL OR step < cut QUALIFY row_number() OVER (PARTITION BY arm ORDER BY moore_humain, step) = 1)"


@query(f"WITH {SIGNALS}, {_KEPT} SELECT * FROM kept")
def curve_best(spark, sf_dir):
    return curves.cut_and_best(with_signals(spark, sf_dir)).filter("kept").select("arm", "step", "moore_humain")


@query(f"WITH {POINTS}, b AS (SELECT arm, step, moore_humain FROM points WHERE arm <> 'base' QUALIFY row_number() OVER (PARTITION BY arm ORDER BY moore_humain, step) = 1) SELECT b.arm, b.step, round(b.moore_humain - r.moore_humain, 6) AS difference FROM b, b r WHERE r.arm = 'B'")
def arms_rank(spark, sf_dir):
    p = points(spark, sf_dir).filter("arm <> 'base'").withColumn("signal", F.lit(False)).withColumn("collapsed", F.lit(None).cast("string"))
    kept = curves.cut_and_best(p).filter("kept")
    return curves.ranked(kept, "B").select("arm", "step", F.round("difference", 6).alias("difference"))


@query(f"WITH {POINTS} SELECT arm, count(*) AS points, min(step) AS first_step, max(step) AS last_step, count(*) >= 3 AS is_curve FROM points WHERE arm <> 'base' GROUP BY arm")
def curve_coverage(spark, sf_dir):
    return curves.coverage(points(spark, sf_dir))


@query(f"WITH {POINTS}, e AS (SELECT arm, step / 240.0 AS epoch, moore_humain AS value FROM points WHERE arm <> 'base') SELECT * FROM e UNION ALL SELECT a.arm, 0.0, b.moore_humain FROM (SELECT DISTINCT arm FROM e) a, points b WHERE b.arm = 'base'")
def curve_table(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("epoch", curves.epoch_of(F.col("arm"), F.col("step"), dict.fromkeys("ABCD", 1200)))
    return curves.curve_table(p, "moore_humain")


@query(f"WITH {_SCORED}, k AS (SELECT DISTINCT id || '-' || conv_id % 3 AS item FROM v WHERE verdict = 'juste' AND grp < 6) SELECT 'x' || grp AS arm, string_agg(DISTINCT id || '-' || conv_id % 3, ',' ORDER BY id || '-' || conv_id % 3) AS lost FROM v WHERE verdict = 'faux' AND id || '-' || conv_id % 3 IN (SELECT item FROM k) GROUP BY grp")
def forgotten(spark, sf_dir):
    v = _scored(spark, sf_dir).select(F.concat(F.lit("x"), "grp").alias("arm"), "grp", F.concat("id", F.lit("-"), F.pmod("conv_id", F.lit(3))).alias("id"), F.col("verdict").alias("note")).withColumn("point", F.lit("p"))
    return curves.forgotten(v.filter("grp < 6"), v).select("arm", F.array_join("lost_ids", ",").alias("lost"))


# --- translation -------------------------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT conv_id AS id, turn AS pos, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1), r AS (SELECT conv_id AS id, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT id, l.pos, l.text AS left_text, r.text AS right_text FROM l JOIN r USING (id)"
)
def align_pairs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("pos"), "role", "text")
    left = c.filter(F.col("role") == "user").groupBy("id").agg(F.min("pos").alias("pos"), F.min_by("text", "pos").alias("text"))
    return chrf.aligned(left, c)


@query(f"WITH {REPLIES} SELECT grp, round(avg(CASE WHEN regexp_matches(lower(obtenu), '[{T.UNIQUE}]') THEN 1 WHEN len({words_sql('obtenu')}) = 0 THEN 0 WHEN {_share('obtenu', _FRENCH)} >= 0.15 THEN 0 WHEN len({words_sql('obtenu')}) >= 2 THEN 1 ELSE 0 END), 6) AS share FROM replies GROUP BY grp")
def language_share(spark, sf_dir):
    rows = replies(spark, sf_dir).withColumn("ok", T.in_target_language(F.col("obtenu"), F.lit("french_to_moore")))
    return rows.groupBy("grp").agg(F.round(F.avg(F.col("ok").cast("int")), 6).alias("share"))


# --- turns -------------------------------------------------------------------------------------------------------------


@query(f"WITH {TURNS} SELECT turn_id, variant FROM turns WHERE split = 'train' AND list_contains({_names(turns.VARIANTS)}, variant)")
def split_variant(spark, sf_dir):
    return turns.chosen(conversations(spark, sf_dir)).select("turn_id", "variant")


@query(f"WITH {TURNS} SELECT variant, count(*) AS turns FROM turns WHERE NOT list_contains({_names((*turns.VARIANTS, *turns.LEFT_OUT))}, variant) GROUP BY variant")
def unlisted_variants(spark, sf_dir):
    return turns.unlisted_variants(conversations(spark, sf_dir))


@query(f"WITH {TURNS} SELECT variant, count(*) AS turns FROM turns GROUP BY variant")
def variant_counts(spark, sf_dir):
    return turns.counts(conversations(spark, sf_dir), "variant")


@query(f"WITH {TURNS} SELECT coalesce(task, '?') AS task, count(*) AS turns FROM turns GROUP BY 1 ORDER BY turns DESC, min(turn_id) LIMIT 8")
def top_tasks(spark, sf_dir):
    return turns.top_tasks(conversations(spark, sf_dir))


@query(f"WITH {TURNS} SELECT CAST(max(list_sum(list_transform(messages, lambda m: length(m.content)))) AS BIGINT) AS longest FROM turns")
def longest_turn(spark, sf_dir):
    return turns.longest(conversations(spark, sf_dir))


_WIDTHS = "CAST(list_sum(list_transform(messages, lambda m: length(m.content))) AS BIGINT) AS full_length, CAST(list_sum(list_transform(messages[1:len(messages) - 1], lambda m: length(m.content))) AS BIGINT) AS prompt_length"


@query(f"WITH {TURNS}, l AS (SELECT *, {_WIDTHS} FROM turns) SELECT turn_id FROM l WHERE len(messages) >= 2 AND messages[len(messages)].role = 'assistant' AND full_length <= 2048 AND coalesce(prompt_length, 0) < full_length")
def usable_turns(spark, sf_dir):
    t = conversations(spark, sf_dir)
    prompt = turns.turn_length(F.slice("messages", F.lit(1), F.greatest(F.size("messages") - 1, F.lit(0))))
    return t.filter(turns.usable(F.col("messages"), prompt, turns.turn_length(F.col("messages")))).select("turn_id")


@query(f"WITH {TURNS}, l AS (SELECT turn_id, list_transform(messages, lambda m: length(m.content)) AS ids FROM turns) SELECT turn_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i < len(ids) THEN -100 ELSE x END), ',') AS labels FROM l")
def label_mask(spark, sf_dir):
    t = conversations(spark, sf_dir).withColumn("ids", F.transform("messages", lambda m: F.length(m["content"])))
    return t.select("turn_id", F.array_join(turns.label_mask(F.col("ids"), F.size("ids") - 1), ",").alias("labels"))


@query(f"WITH {TURNS} SELECT turn_id FROM turns WHERE variant = 'mos_mos' ORDER BY md5('20260912:' || turn_id), turn_id LIMIT 3")
def sample_held(spark, sf_dir):
    return turns.sampled(conversations(spark, sf_dir).filter("variant = 'mos_mos'"), 3).select("turn_id")


# --- runs --------------------------------------------------------------------------------------------------------------


def _listing(spark, sf_dir):
    e = log(spark, sf_dir)
    return e.filter("eval_loss IS NOT NULL").select(F.concat("run", F.lit("/checkpoint-"), "pas", F.lit("/adapter.bin")).alias("key"))


_LISTED = f"{LOG}, listed AS (SELECT DISTINCT run, 'checkpoint-' || pas AS name, pas AS step FROM log WHERE eval_loss IS NOT NULL)"


@query(f"WITH {_LISTED} SELECT run, name, step FROM listed")
def checkpoint_order(spark, sf_dir):
    return runs.checkpoints(_listing(spark, sf_dir))


@query(f"WITH {_LISTED} SELECT run, name, step FROM listed QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) = 1")
def latest_checkpoint(spark, sf_dir):
    return runs.latest(runs.checkpoints(_listing(spark, sf_dir)))


_ACTIONS = "o AS (SELECT run, step, row_number() OVER (PARTITION BY run, step // 97 ORDER BY step) = 1 AS opens, lead(step) OVER (PARTITION BY run ORDER BY step) AS nxt FROM listed), actions AS (SELECT run, step, CASE WHEN nxt IS NULL THEN NULL WHEN opens THEN 'prune' ELSE 'delete' END AS action FROM o)"


@query(f"WITH {_LISTED}, {_ACTIONS} SELECT l.run, 'checkpoint-' || l.pas AS name, l.pas AS step, l.eval_loss FROM log l JOIN actions a ON l.run = a.run AND l.pas = a.step WHERE l.eval_loss IS NOT NULL AND coalesce(a.action, '') <> 'delete' QUALIFY row_number() OVER (PARTITION BY l.run ORDER BY l.eval_loss, l.pas) = 1")
def by_eval(spark, sf_dir):
    """Among the checkpoints that retention has left."""
    left = runs.retention(runs.checkpoints(_listing(spark, sf_dir)).select("run", "step"), 97, keep_all=False).filter("action IS NULL OR action <> 'delete'")
    return runs.by_eval(log(spark, sf_dir), left)


@query(f"WITH {_LISTED} SELECT run, step, row_number() OVER (PARTITION BY run, step // 97 ORDER BY step) = 1 AS opens FROM listed")
def epoch_saves(spark, sf_dir):
    return runs.epoch_saves(runs.checkpoints(_listing(spark, sf_dir)).select("run", "step"), 97)


@query(f"WITH {_LISTED}, {_ACTIONS} SELECT run, step, action FROM actions")
def retention_plan(spark, sf_dir):
    return runs.retention(runs.checkpoints(_listing(spark, sf_dir)).select("run", "step"), 97, keep_all=False).select("run", "step", "action")


@query("SELECT o_orderkey, CASE WHEN o_custkey >= 700 THEN 'there is nothing left to train' WHEN o_orderkey % 3 <> 0 AND o_orderkey % 1000 <> 700 THEN 'the set or the epoch count has changed since' END AS refused FROM orders")
def resume_refused(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    before = F.when(F.pmod("o_orderkey", F.lit(3)) != 0, F.pmod("o_orderkey", F.lit(1000)))
    return o.select("o_orderkey", runs.resume_refused(F.col("o_custkey"), before, F.lit(700)).alias("refused"))


@query(f"WITH {LOG} SELECT run, pas AS step, eval_loss FROM log WHERE eval_loss IS NOT NULL QUALIFY row_number() OVER (PARTITION BY run ORDER BY eval_loss, pas) = 1")
def log_stream(spark, sf_dir):
    """The log as a stream, read to its end, with the best loss of each run as its state."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet" if not _is_folder(spark, f"{sf_dir}/events.parquet") else "*.parquet").parquet(sf_dir if not _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events.parquet")
    rows = stream.select(F.concat(F.lit("run-"), F.pmod("user_id", F.lit(8))).alias("run"), F.col("event_id").alias("pas"), F.when(F.col("event_type") == F.lit("error"), F.round("value", 4)).alias("eval_loss"))
    out, progress = (f"{shared_dir(spark)}/corpusloom/{kind}-{uuid.uuid4().hex}" for kind in ("best", "progress"))
    kept = logs.best_so_far(rows).writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    kept.option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def _is_folder(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
