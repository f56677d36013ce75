"""Question routing, documents, nearest vectors and formatted columns."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import columns as c
from ..functions import text as t
from ..operators import joins as j
from ..operators import neighbours as n
from ..operators import retrieval as r
from ..operators import routing as ro
from ..session import scratch
from ..sources.binding import chat_log, table, view
from .registry import query, _rounded
from .templates import PROFILE_SUMMARY_SQL

# The prose of the chat table rarely contains a domain word, so a few plain questions are added to it.
QUESTIONS = (
    "hello!", "What is the average temperature at different depths?",
    "Compare salinity between northern and southern regions", "Show temperature trends over time",
    "Show summary statistics for each float", "pH levels near the surface", "Count measurements by month",
    "good morning", "thanks", "tell me a story about ships", "who cares", "oxygen and biogeochemical values",
    "average temperature of each cycle with depth", "float count", "How many are there?",
)
STATEMENTS = (
    "SELECT * FROM measurements", "  select depth from measurements", "DROP TABLE floats",
    "SELECT created_at FROM floats", "WITH a AS (SELECT 1) SELECT * FROM a", "select 1; delete from floats",
)


def _literals(values) -> str:
    return ", ".join("('%s')" % v.replace("'", "''") for v in values)


def _questions(spark, folder):
    said = chat_log(spark, folder).select(F.concat_ws("-", "conv_id", "turn").alias("question_id"), "text")
    asked = spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(QUESTIONS)], "question_id string, text string")
    return said.unionByName(asked)


ASKED = f"""qs AS (SELECT concat_ws('-', conv_id, turn) AS question_id, text FROM conversations
  UNION ALL SELECT concat('q', row_number() OVER () - 1), text FROM (VALUES {_literals(QUESTIONS)}) v(text))"""


def _sql_any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


LABEL_SQL = f"""CASE WHEN regexp_matches(trim(text, E' \\n\\t\\r'), '{t.GREETING.replace("'", "''")}') THEN 'chat'
  WHEN regexp_matches(trim(text, E' \\n\\t\\r'), '{t.DOMAIN_WORD}') THEN 'data'
  WHEN trim(text, E' \\n\\t\\r') = '' THEN 'chat'
  WHEN len(regexp_split_to_array(trim(text, E' \\n\\t\\r'), '\\s+')) <= 3 THEN 'chat' ELSE 'data' END"""
ANALYTICAL_SQL = "(" + " OR ".join(f"regexp_matches(lower(text), '{p}')" for p in t.ANALYTICAL) + ")"
INTENT_SQL = "CASE " + " ".join(
    f"WHEN {' AND '.join(_sql_any('lower(text)', g) for g in groups)} THEN '{name}'"
    for name, groups in t.INTENTS) + " ELSE 'custom' END"


@query("classify_questions", sql=f"WITH {ASKED}\nSELECT *, {LABEL_SQL} AS label FROM qs")
def classify_questions(spark, folder):
    return ro.classify_questions(_questions(spark, folder))


@query("analytical_flag", sql=f"WITH {ASKED}\nSELECT *, {ANALYTICAL_SQL} AS is_analytical FROM qs")
def analytical_flag(spark, folder):
    return ro.analytical_flag(_questions(spark, folder))


@query("detect_intent", sql=f"WITH {ASKED}\nSELECT *, {INTENT_SQL} AS intent FROM qs")
def detect_intent(spark, folder):
    return ro.detect_intent(_questions(spark, folder))


@query("route_counts", sql=f"""WITH {ASKED}
SELECT {LABEL_SQL} AS label, {ANALYTICAL_SQL} AS is_analytical, {INTENT_SQL} AS intent, count(*) AS questions
FROM qs GROUP BY 1, 2, 3""")
def route_counts(spark, folder):
    return ro.route_counts(_questions(spark, folder))


@query("sql_guard", sql=f"""
WITH st AS (SELECT concat('select note from log where note = ', text) AS text FROM conversations
  UNION ALL SELECT text FROM (VALUES {_literals(STATEMENTS)}) v(text))
SELECT text, NOT {_sql_any('lower(text)', t.FORBIDDEN_SQL)} AND starts_with(trim(lower(text)), 'select') AS allowed
FROM st""")
def sql_guard(spark, folder):
    said = chat_log(spark, folder).select(F.concat(F.lit("select note from log where note = "), "text").alias("text"))
    return ro.sql_guard(said.unionByName(spark.createDataFrame([(s,) for s in STATEMENTS], "text string")))


@query("chat_statistics", sql="""
SELECT *, (ai_messages - errors) * 100e0 / greatest(ai_messages, 1) AS success_rate FROM (
  SELECT count(*) AS total, count(*) FILTER (WHERE role = 'user') AS user_messages,
         count(*) FILTER (WHERE role = 'assistant') AS ai_messages,
         count(*) FILTER (WHERE role = 'assistant' AND length(text) < 100) AS errors FROM conversations)""",
       doubles="success_rate")
def chat_statistics(spark, folder):
    """A very short answer counts as an error."""
    return ro.chat_statistics(chat_log(spark, folder), F.length("text") < 100)


# --- fixed values: the wording of the documents ---------------------------------------------------------------
MEASURED_TEXT = """concat('ARGO float ', float_id, ' (WMO ID: ', wmo_id, ') recorded measurements on ',
  strftime(time, '%Y-%m-%d'), ' during cycle ', cycle_number, '. The float was located at latitude ',
  printf('%.3f', lat), '° and longitude ', printf('%.3f', lon), '°. At a depth of ', printf('%.1f', depth),
  ' meters, the temperature was ', coalesce(printf('%.2f', temperature) || '°C', 'not available'),
  ' and the salinity was ', coalesce(printf('%.2f', salinity) || ' PSU', 'not available'), '.',
  coalesce(' The dissolved oxygen was ' || printf('%.2f', oxygen) || ' ml/L.', ''),
  coalesce(' The pH was ' || printf('%.2f', ph) || '.', ''),
  CASE WHEN chlorophyll > 0.01e0 THEN ' The chlorophyll concentration was ' || printf('%.3f', chlorophyll) || ' mg/m³.'
       ELSE '' END,
  ' This measurement was part of a profile with ', n_levels, ' depth levels. The float was deployed on ',
  CAST(deployment_date AS VARCHAR), '.')"""
# ----------------------------------------------------------------------------------------------------------
CONTEXT = """ctx AS (SELECT m.*, p.cycle_number, p.profile_date, p.n_levels, f.wmo_id, f.deployment_date
  FROM measurements m JOIN profiles p ON m.profile_id = p.profile_id JOIN floats f ON m.float_id = f.float_id)"""


def _context(spark, folder):
    return j.readings_context(view(spark, folder, "readings"), view(spark, folder, "profiles"), view(spark, folder, "floats"))


@query("measurement_documents", views="measurements profiles floats",
       sql=f"WITH {CONTEXT}\nSELECT id, {MEASURED_TEXT} AS document FROM ctx")
def measurement_documents(spark, folder):
    return r.measurement_documents(_context(spark, folder))


@query("measurement_metadata", views="measurements profiles floats", sql=f"""WITH {CONTEXT}
SELECT id AS postgres_id, profile_id, CAST(float_id AS VARCHAR) AS float_id, wmo_id, cycle_number,
       strftime(time, '%Y-%m-%d') AS time, strftime(profile_date, '%Y-%m-%d') AS profile_date,
       strftime(profile_date, '%Y-%m-%d') AS date, depth, lat, lon, lat AS latitude, lon AS longitude, n_levels,
       oxygen IS NOT NULL OR ph IS NOT NULL OR chlorophyll IS NOT NULL AS has_bgc, temperature, salinity, oxygen,
       chlorophyll FROM ctx""",
       doubles="depth lat lon latitude longitude temperature salinity oxygen chlorophyll")
def measurement_metadata(spark, folder):
    return r.measurement_metadata(_context(spark, folder))


@query("stored_documents", views="measurements profiles floats",
       sql=f"WITH {CONTEXT}\nSELECT id, {MEASURED_TEXT} AS document FROM ctx")
def stored_documents(spark, folder):
    """All documents written with their ids and read again."""
    path = scratch(spark)
    r.write_documents(r.measurement_documents(_context(spark, folder)), path)
    return spark.read.parquet(path)


AVERAGES = ("avg_temp", "avg_sal", "avg_oxygen", "avg_ph", "avg_chlorophyll")


@query("profile_documents", views="profiles float_cards readings", sql=f"""
WITH s AS (SELECT * REPLACE ({', '.join(f'round({a} + 1e-9, 4) AS {a}' for a in AVERAGES)}) FROM ({PROFILE_SUMMARY_SQL}))
SELECT concat('profile_', profile_id) AS id, concat('ARGO float ', float_id, ' (WMO ', wmo_id,
  ') completed profile cycle ', cycle_number, ' on ', strftime(profile_date, '%Y-%m-%d'), ' at location ',
  printf('%.3f', profile_lat), '°, ', printf('%.3f', profile_lon), '°. This profile contains ', n_levels,
  ' measurements spanning depths from ', printf('%.0f', min_depth), 'm to ', printf('%.0f', max_depth),
  'm. Temperature ranged from ',
  coalesce(printf('%.1f', min_temp) || '°C to ' || printf('%.1f', max_temp) || '°C', 'not available'),
  ' and salinity from ', coalesce(printf('%.2f', min_sal) || ' to ' || printf('%.2f', max_sal) || ' PSU',
  'not available'), '.', coalesce(' Average oxygen was ' || printf('%.2f', avg_oxygen) || ' ml/L.', ''),
  coalesce(' Average pH was ' || printf('%.2f', avg_ph) || '.', ''),
  coalesce(' Average chlorophyll was ' || printf('%.3f', avg_chlorophyll) || ' mg/m³.', '')) AS document,
  profile_id, CAST(float_id AS VARCHAR) AS float_id, wmo_id, cycle_number,
  strftime(profile_date, '%Y-%m-%d') AS profile_date, profile_lat AS lat, profile_lon AS lon, n_levels, min_depth,
  max_depth, min_temp, max_temp, avg_oxygen IS NOT NULL AS has_bgc FROM s""",
       doubles="lat lon min_depth max_depth min_temp max_temp")
def profile_documents(spark, folder):
    summary = j.profile_summary(view(spark, folder, "profiles"), view(spark, folder, "float_cards"),
                                view(spark, folder, "readings"))
    return r.profile_documents(_rounded(summary, list(AVERAGES)))




def _distance_sql(left: str, right: str) -> str:
    return (f"list_sum([(CAST({left}[i] AS DOUBLE) - CAST({right}[i] AS DOUBLE)) * "
            f"(CAST({left}[i] AS DOUBLE) - CAST({right}[i] AS DOUBLE)) FOR i IN range(1, len({left}) + 1)])")


def _first_vector(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return vectors.agg(F.min_by("embedding", "vec_id")).first()[0]


TOP_SQL = f"""q AS (SELECT arg_min(embedding, vec_id) AS v FROM embeddings),
hits AS (SELECT vec_id, label, d AS distance, row_number() OVER (ORDER BY d, vec_id) AS rank
  FROM (SELECT vec_id, label, {_distance_sql('embedding', 'v')} AS d FROM embeddings, q)
  QUALIFY rank <= 20)"""


@query("vector_topk", sql=f"WITH {TOP_SQL}\nSELECT vec_id, label, distance, CAST(rank AS INT) AS rank FROM hits",
       doubles="distance")
def vector_topk(spark, folder):
    """Nearest to the first vector of the table."""
    return r.vector_topk(table(spark, folder, "embeddings"), list(_first_vector(spark, folder)))


BATCH_SQL = f"""q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label),
hits AS (SELECT query_id, vec_id, d AS distance,
    row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank
  FROM (SELECT query_id, vec_id, {_distance_sql('embedding', 'v')} AS d FROM embeddings, q)
  QUALIFY rank <= 20)"""


def _batch(spark, folder):
    vectors = table(spark, folder, "embeddings")
    asked = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))
    return r.vector_topk_batch(vectors, asked)


@query("vector_topk_batch", sql=f"WITH {BATCH_SQL}\nSELECT query_id, vec_id, distance, CAST(rank AS INT) AS rank FROM hits",
       doubles="distance")
def vector_topk_batch(spark, folder):
    """Nearest to the first vector of every label."""
    return _batch(spark, folder)


# Every tenth vector is missing and every tenth is cut short: neither may be found, nor hide what can be.
FAULTY_SQL = "SELECT vec_id, CASE vec_id % 10 WHEN 3 THEN NULL WHEN 4 THEN embedding[1:5] ELSE embedding END AS embedding FROM embeddings"


def _faulty(spark, folder):
    return table(spark, folder, "embeddings").select("vec_id", F.when(F.col("vec_id") % 10 == 3, None).when(
        F.col("vec_id") % 10 == 4, F.slice("embedding", 1, 5)).otherwise(F.col("embedding")).alias("embedding"))


@query("vector_topk_faulty", sql=f"""
WITH e AS ({FAULTY_SQL}), q AS (SELECT vec_id AS query_id, embedding AS v FROM e WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, d AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS INT) AS rank
FROM (SELECT query_id, vec_id, {_distance_sql('embedding', 'v')} AS d FROM e, q WHERE len(embedding) = len(v))
QUALIFY rank <= 20""", doubles="distance")
def vector_topk_faulty(spark, folder):
    """Nearest to every hundredth vector among vectors some of which are missing or cut short."""
    vectors = _faulty(spark, folder)
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return r.vector_topk_batch(vectors, asked)


@query("vector_rejects", sql=f"""
SELECT vec_id, CAST(coalesce(len(embedding), -1) AS INT) AS components,
       CASE WHEN embedding IS NULL THEN 'no vector' ELSE 'wrong length' END AS reason
FROM ({FAULTY_SQL}) WHERE embedding IS NULL OR len(embedding) <> 64""")
def vector_rejects(spark, folder):
    """Vectors that a search with 64 components leaves out."""
    return r.rejected_vectors(_faulty(spark, folder), 64).withColumn("components", F.coalesce("components", F.lit(-1)))


def _asked(spark, folder):
    """Every tenth vector."""
    return table(spark, folder, "embeddings").filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("vector_topk_approx", sql="""
SELECT vec_id AS query_id, CAST(20 AS BIGINT) AS neighbours, CAST(0 AS DOUBLE) AS nearest, TRUE AS itself
FROM embeddings WHERE vec_id % 10 = 0""", doubles="nearest")
def vector_topk_approx(spark, folder):
    """The index finds 20 neighbours of every tenth vector, the vector itself first."""
    near = n.vector_topk_approx(table(spark, folder, "embeddings"), _asked(spark, folder))
    return near.groupBy("query_id").agg(F.count("*").alias("neighbours"), F.min("distance").alias("nearest"),
                                        F.bool_or((F.col("vec_id") == F.col("query_id")) & (F.col("distance") == 0)).alias("itself"))


@query("vector_recall", sql="""
SELECT count(*) AS queries, 20 * count(*) AS neighbours, TRUE AS enough FROM embeddings WHERE vec_id % 10 = 0""")
def vector_recall(spark, folder):
    """At least 0.95 of the 20 exact neighbours of every tenth vector are among those that the index finds."""
    vectors, asked = table(spark, folder, "embeddings"), _asked(spark, folder)
    found = n.recall_of(n.vector_topk_approx(vectors, asked), r.vector_topk_batch(vectors, asked))
    return found.select("queries", "neighbours", (F.col("recall") >= 0.95).alias("enough"))


HIT_SQL = """SELECT h.rank, m.* FROM hits h JOIN (
  SELECT p.profile_id AS vec, p.float_id, strftime(p.profile_date, '%Y-%m-%d') AS date, p.profile_lat AS latitude,
         p.profile_lon AS longitude, max(r.depth) AS depth, arg_min(temperature, id) AS temperature,
         arg_min(salinity, id) AS salinity,
         arg_min(oxygen, id) FILTER (WHERE oxygen IS NOT NULL) AS oxygen
  FROM casts p JOIN readings r ON p.profile_id = r.profile_id GROUP BY ALL) m ON h.vec_id = m.vec"""


def _hits(spark, folder):
    """Hits carrying the fields of the profile that has the vector's number."""
    near = r.vector_topk(table(spark, folder, "embeddings"), list(_first_vector(spark, folder)))
    casts = view(spark, folder, "casts").join(F.broadcast(near.select("vec_id", "rank")),  # bound: 20 rows
                                              F.col("vec_id") == F.col("profile_id"))
    first = lambda name: F.min_by(name, F.when(F.col(name).isNotNull(), F.col("id"))).alias(name)
    return casts.join(view(spark, folder, "readings"), "profile_id").groupBy(
        "rank", "float_id", F.date_format("profile_date", "yyyy-MM-dd").alias("date"),
        F.col("profile_lat").alias("latitude"), F.col("profile_lon").alias("longitude"),
    ).agg(F.max("depth").alias("depth"), first("temperature"), first("salinity"), first("oxygen"))


@query("hit_statistics", views="casts readings", sql=f"""WITH {TOP_SQL},
m AS ({HIT_SQL})
SELECT count(*) AS hits, avg(temperature) AS avg_temperature, min(temperature) AS min_temperature,
       max(temperature) AS max_temperature, count(temperature) AS count_temperature, avg(salinity) AS avg_salinity,
       min(salinity) AS min_salinity, max(salinity) AS max_salinity, count(salinity) AS count_salinity FROM m""",
       doubles="avg_temperature min_temperature max_temperature avg_salinity min_salinity max_salinity")
def hit_statistics(spark, folder):
    return r.hit_statistics(_hits(spark, folder))


@query("context_lines", views="casts readings", sql=f"""WITH {TOP_SQL},
m AS ({HIT_SQL})
SELECT CAST(rank AS INT) AS rank, concat('[', rank, ']', ' Float=' || float_id, ' | Date=' || date,
  ' | Lat=' || printf('%.2f', latitude), ' | Lon=' || printf('%.2f', longitude), ' | Depth=' || printf('%.0f', depth) || 'm',
  ' | Temp=' || printf('%.2f', temperature) || '°C', ' | Sal=' || printf('%.2f', salinity) || ' PSU',
  ' | O2=' || printf('%.2f', oxygen) || ' ml/L') AS line FROM m""")
def context_lines(spark, folder):
    return r.context_lines(_hits(spark, folder))


@query("retrieval_metadata", sql=f"""WITH {BATCH_SQL}
SELECT query_id, string_agg(CAST(h.vec_id AS VARCHAR), ',' ORDER BY rank) AS ids,
       array_to_string(list_sort(list_distinct(list(CAST(label AS INT)))), ',') AS float_ids,
       CAST(count(DISTINCT label) AS INT) AS float_count, count(*) AS data_count, false AS has_sql_results
FROM hits h JOIN embeddings e ON h.vec_id = e.vec_id GROUP BY query_id""")
def retrieval_metadata(spark, folder):
    labels = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("float_id"))
    hits = _batch(spark, folder).join(labels, "vec_id").withColumnRenamed("vec_id", "id")
    return ro.retrieval_metadata(hits, "query_id")


@query("format_columns", views="measurements", sql="""
SELECT id,
  CASE WHEN temperature IS NULL THEN 'N/A' WHEN abs(temperature) < 0.01e0 OR abs(temperature) >= 1000
       THEN printf('%.2e', temperature) ELSE printf('%.2f', temperature) END AS scientific_temperature,
  CASE WHEN abs(depth) < 0.01e0 OR abs(depth) >= 1000 THEN printf('%.2e', depth) ELSE printf('%.2f', depth) END
    AS scientific_depth,
  coalesce(printf('%.2f', temperature) || ' °C', 'N/A') AS temperature_text, printf('%.2f', ph) AS ph_text,
  coalesce(printf('%.2f', oxygen) || ' ml/L', 'N/A') AS oxygen_text, printf('%.0f', pressure) || ' dbar'
    AS pressure_text,
  CASE WHEN oxygen IS NULL OR oxygen = 0 OR temperature IS NULL THEN 0e0 ELSE temperature / oxygen END AS ratio,
  strftime(time, '%Y-%m-%d %H:%M:%S') || ' UTC' AS time_text, round(lat / 7 + 1e-9, 6) AS lat_compact,
  CAST(date_trunc('month', time) AS TIMESTAMP) AS month, round(CAST(salinity AS DECIMAL(38, 10)), 2)::DOUBLE
    AS salinity_rounded,
  try_cast(split_part(id, '-', 1) AS DOUBLE) AS parsed, try_cast(id AS DOUBLE) AS unparsed
FROM measurements""", doubles="ratio lat_compact salinity_rounded parsed unparsed")
def format_columns(spark, folder):
    col = F.col
    return view(spark, folder, "measurements").select(
        "id", c.scientific(col("temperature")).alias("scientific_temperature"),
        c.scientific(col("depth")).alias("scientific_depth"),
        c.with_unit(col("temperature"), "temperature").alias("temperature_text"),
        c.with_unit(col("ph"), "ph").alias("ph_text"), c.with_unit(col("oxygen"), "oxygen").alias("oxygen_text"),
        c.with_unit(col("pressure"), "pressure").alias("pressure_text"),
        c.safe_divide(col("temperature"), col("oxygen")).alias("ratio"), c.utc_text(col("time")).alias("time_text"),
        c.compact(col("lat") / 7 + 1e-9).alias("lat_compact"), c.month_of(col("time")).alias("month"),
        F.round(col("salinity").cast("decimal(38,10)"), 2).cast("double").alias("salinity_rounded"),
        c.safe_float(F.split_part("id", F.lit("-"), F.lit(1))).alias("parsed"),
        c.safe_float(col("id")).alias("unparsed"),
    )


@query("truncated_text", sql="""
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS short FROM documents""")
def truncated_text(spark, folder):
    return table(spark, folder, "documents").select("doc_id", c.truncated(F.col("text")).alias("short"))
