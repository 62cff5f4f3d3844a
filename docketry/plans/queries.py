"""Registered queries over the test tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry import config as C
from docketry.config import ScoringConfig
from docketry.functions.keywords import keywords
from docketry.functions.text import has_any_phrase, folded, mask_secrets, or_dash, squeeze
from docketry.operators import history as H
from docketry.operators.ranking import band_summary, top, with_rank
from docketry.operators.scoring import badge, band, concept_hits, mode_notice, score_records
from docketry.operators.snapshots import snapshot_changes
from docketry.operators.unpack import delimiter_scores, unpack_codes
from docketry.operators.validity import versions
from docketry.plans import sql as S
from docketry.plans.tables import RECORDS_SQL, records, table
from docketry.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

TECHNOLOGY = "전기차 배터리 냉각"
ALL = ("vehicle", "battery", "cooling")
GENERIC = "고압 센서와 유로를 위한 방법"
SCORED = ("ord", "relevance_score", "review_priority", "matched_concepts", "score_reason")

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where it can be said in SQL, the statement that checks it."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def _scored(spark: SparkSession, d: str, technology: str = TECHNOLOGY) -> DataFrame:
    return score_records(records(spark, d), technology)


@query("phrase_filter", f"WITH {RECORDS_SQL} SELECT ord FROM records WHERE {S.any_phrase('abstract', ('냉각', 'cooling'))}")
def phrase_filter(spark, d):
    return records(spark, d).filter(has_any_phrase(folded(F.col("abstract")), ("냉각", "Cooling"))).select("ord")


@query(
    "ipc_families",
    f"WITH {RECORDS_SQL} SELECT ord, {S.family('H01M')} AS h01m, {S.family('B60L')} AS b60l FROM records",
)
def ipc_families(spark, d):
    hits = concept_hits(records(spark, d), TECHNOLOGY)
    return hits.select("ord", F.col("hit_H01M").alias("h01m"), F.col("hit_B60L").alias("b60l"))


@query(
    "concept_hits",
    f"WITH {S.hits(ALL)} SELECT ord, "
    + ", ".join(f"{s}_{g} AS hit_{n}_{g}" for g in ALL for s, n in (("t", "title"), ("a", "abstract")))
    + " FROM hits",
)
def concept_hits_q(spark, d):
    cols = [f"hit_{n}_{g}" for g in ALL for n in ("title", "abstract")]
    return concept_hits(records(spark, d), TECHNOLOGY).select("ord", *cols)


@query("concept_score", f"{S.scored(ALL)} SELECT ord, relevance_score, review_priority FROM scored")
def concept_score(spark, d):
    return _scored(spark, d).select("ord", "relevance_score", "review_priority")


@query("concept_reasons", f"{S.scored(ALL)} SELECT ord, matched_concepts, score_reason, 'concept_group' AS analysis_mode FROM scored")
def concept_reasons(spark, d):
    return _scored(spark, d).select("ord", "matched_concepts", "score_reason", "analysis_mode")


for _name, _tech, _groups in (
    ("single_core_score", "배터리", ("battery",)),
    ("cooling_score", "냉각수 펌프", ("cooling",)),
    ("vehicle_score", "자동차", ("vehicle",)),
    ("vehicle_cooling_score", "차량 열관리", ("vehicle", "cooling")),
):
    query(_name, f"{S.scored(_groups)} SELECT {', '.join(SCORED)} FROM scored")(
        lambda spark, d, t=_tech: _scored(spark, d, t).select(*SCORED)
    )


@query("generic_score", f"{S.generic(keywords(GENERIC))} SELECT ord, relevance_score, review_priority FROM g")
def generic_score(spark, d):
    return _scored(spark, d, GENERIC).select("ord", "relevance_score", "review_priority")


@query("generic_reasons", f"{S.generic(keywords(GENERIC))} SELECT ord, matched_concepts, score_reason, 'generic_keyword' AS analysis_mode FROM g")
def generic_reasons(spark, d):
    return _scored(spark, d, GENERIC).select("ord", "matched_concepts", "score_reason", "analysis_mode")


@query(
    "no_keyword_score",
    f"WITH {RECORDS_SQL} SELECT ord, 0.0::DOUBLE AS relevance_score, '{C.PRIORITY_LOW}' AS review_priority, "
    f"'' AS matched_concepts, '{C.NO_KEYWORD_REASON}' AS score_reason FROM records",
)
def no_keyword_score(spark, d):
    return _scored(spark, d, "방법 및 장치").select(*SCORED)


@query(
    "no_group_score",
    f"WITH {RECORDS_SQL} SELECT ord, 0.0::DOUBLE AS relevance_score, '{C.PRIORITY_LOW}' AS review_priority, "
    f"'' AS matched_concepts, '{C.NO_GROUP_REASON}' AS score_reason FROM records",
)
def no_group_score(spark, d):
    return score_records(records(spark, d), GENERIC, ScoringConfig(fallback="none")).select(*SCORED)


@query(
    "band",
    "SELECT CAST(v AS DOUBLE) AS score, " + S.band("CAST(v AS DOUBLE)") + " AS review_priority FROM (VALUES (0.0), (39.9), (40.0), (69.9), (70.0), (100.0)) t(v)",
)
def band_q(spark, d):
    rows = spark.createDataFrame([(x,) for x in (0.0, 39.9, 40.0, 69.9, 70.0, 100.0)], "score double")
    return rows.withColumn("review_priority", band(F.col("score")))


@query("rank_all", f"{S.scored(ALL)} SELECT ord, relevance_score, row_number() OVER (ORDER BY relevance_score DESC, ord) AS rank FROM scored")
def rank_all(spark, d):
    return with_rank(_scored(spark, d)).select("ord", "relevance_score", "rank")


@query("top20", f"{S.scored(ALL)} SELECT {', '.join(SCORED)} FROM scored ORDER BY relevance_score DESC, ord LIMIT 20")
def top20(spark, d):
    return top(_scored(spark, d), 20).select(*SCORED)


@query(
    "priority_summary",
    f"{S.scored(ALL)} SELECT count(*) AS total, "
    + ", ".join(f"count(*) FILTER (review_priority = '{p}') AS {n}" for n, p in (("high", C.PRIORITY_HIGH), ("medium", C.PRIORITY_MEDIUM), ("low", C.PRIORITY_LOW)))
    + " FROM scored",
)
def priority_summary(spark, d):
    return band_summary(_scored(spark, d))


@query("mode_notice", f"SELECT '{C.GENERIC_NOTICE}' AS notice")
def mode_notice_q(spark, d):
    return spark.range(1).select(F.lit(mode_notice(GENERIC)).alias("notice"))


@query(
    "history_group",
    """SELECT "applicationNumber" AS application_number, count(*) AS n_entries, min(ord) AS first_ord, max(ord) AS last_ord
    FROM judgments WHERE coalesce("applicationNumber", '') <> '' GROUP BY 1""",
)
def history_group(spark, d):
    log = H.keyed(table(spark, d, "judgments"))
    return log.groupBy(F.col("applicationNumber").alias("application_number")).agg(
        F.count("*").alias("n_entries"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord")
    )


@query(
    "latest_judgment",
    f"""WITH {S.LATEST} SELECT "applicationNumber" AS application_number, ord, decision, "decisionTime" AS decision_time, n_entries FROM latest""",
)
def latest_judgment(spark, d):
    return H.latest_entries(table(spark, d, "judgments")).select(
        F.col("applicationNumber").alias("application_number"), "ord", "decision",
        F.col("decisionTime").alias("decision_time"), "n_entries",
    )


def _compared(spark, d):
    return H.compare_with_latest(_scored(spark, d), table(spark, d, "judgments"))


@query(
    "ranked_with_history",
    f"{S.compared()} SELECT ord, coalesce(nullif(application_number, ''), '-') AS application_number, coalesce(n_entries, 0) AS n_entries, decision AS latest_decision, latest_time FROM diffs",
)
def ranked_with_history(spark, d):
    return _compared(spark, d).select(
        "ord", or_dash(F.col("application_number")).alias("application_number"), "n_entries", "latest_decision", "latest_time"
    )


_CHANGED = " UNION ALL ".join(
    f"SELECT ord, '{label}' AS field, p{i} AS previous, c{i} AS current FROM diffs WHERE n_entries IS NOT NULL AND p{i} <> c{i}"
    for i, (_, _, label) in enumerate(H.COMPARED)
)


@query("changed_fields", f"{S.compared()} {_CHANGED}")
def changed_fields(spark, d):
    return H.changed_fields(_compared(spark, d), "ord")


@query(
    "review_state",
    f"""{S.compared()} SELECT ord, CASE WHEN n_entries IS NULL THEN '{C.STATE_NONE}'
      WHEN p0 <> c0 OR p1 <> c1 OR p2 <> c2 THEN '{C.STATE_CHANGED}' ELSE '{C.STATE_SAME}' END AS review_state FROM diffs""",
)
def review_state(spark, d):
    return _compared(spark, d).select("ord", "review_state")


@query("reviewed", f"WITH {RECORDS_SQL} SELECT ord FROM records r WHERE application_number <> '' AND EXISTS (SELECT 1 FROM judgments j WHERE j.\"applicationNumber\" = r.application_number)")
def reviewed(spark, d):
    return H.reviewed(records(spark, d), table(spark, d, "judgments")).select("ord")


@query("unreviewed", f"WITH {RECORDS_SQL} SELECT ord FROM records r WHERE application_number = '' OR NOT EXISTS (SELECT 1 FROM judgments j WHERE j.\"applicationNumber\" = r.application_number)")
def unreviewed(spark, d):
    return H.unreviewed(records(spark, d), table(spark, d, "judgments")).select("ord")


@query(
    "history_listing",
    """SELECT ord, decision, row_number() OVER (PARTITION BY "applicationNumber" ORDER BY coalesce("decisionTime", '') DESC, ord) AS position
    FROM judgments WHERE coalesce("applicationNumber", '') <> ''""",
)
def history_listing(spark, d):
    return H.history_listing(table(spark, d, "judgments")).select("ord", "decision", "position")


@query(
    "record_history",
    f"""WITH {RECORDS_SQL}, h AS (SELECT *, row_number() OVER (PARTITION BY "applicationNumber" ORDER BY coalesce("decisionTime", '') DESC, ord) AS position
      FROM judgments WHERE coalesce("applicationNumber", '') <> '')
    SELECT r.ord, max((h.position - 1) // 1000 + 1) AS page, string_agg(h.position || ' ' || coalesce(h.decision, '') || ' ' || coalesce(h."decisionTime", ''), chr(10) ORDER BY h.position) AS entries
    FROM records r LEFT JOIN h ON r.application_number = h."applicationNumber" GROUP BY r.ord, (h.position - 1) // 1000""",
)
def record_history(spark, d):
    found = H.with_history(records(spark, d), table(spark, d, "judgments"))
    empty = F.lit("")
    line = lambda e: F.concat_ws(" ", e["position"], F.coalesce(e["decision"], empty), F.coalesce(e["decisionTime"], empty))
    return found.select("ord", "page", F.array_join(F.transform("entries", line), "\n").alias("entries"))


@query(
    "difference_display",
    f"""{S.compared()} SELECT ord, field, coalesce(nullif(previous, ''), '{C.EMPTY_SNAPSHOT}') AS previous,
      coalesce(nullif(current, ''), '{C.EMPTY_SNAPSHOT}') AS current FROM ({_CHANGED})""",
)
def difference_display(spark, d):
    return H.displayed_differences(_compared(spark, d), "ord")


_SHOWN = ("applicant", "ipc", "register_status", "matched_concepts", "score_reason")


@query(
    "record_display",
    f"{S.scored(ALL)} SELECT ord, coalesce(nullif(title, ''), '{C.UNTITLED}') AS title, coalesce(nullif(application_number, ''), '-') AS application_number, "
    + ", ".join(f"coalesce(nullif({c}, ''), '-') AS {c}" for c in _SHOWN)
    + " FROM scored",
)
def record_display(spark, d):
    return H.displayed(_scored(spark, d)).select("ord", "title", "application_number", *_SHOWN)


@query(
    "decision_snapshot",
    f"""{S.scored(ALL)} SELECT application_number AS "applicationNumber", title AS "inventionTitle", '추가 검토' AS decision,
      '근거' AS "decisionReason", '2026-01-01T09:00:00+09:00' AS "decisionTime", register_status AS "registerStatusAtDecision",
      applicant AS "applicantNameAtDecision", ipc AS "ipcNumberAtDecision", relevance_score AS "relevanceScoreAtDecision",
      review_priority AS "reviewPriorityAtDecision" FROM scored""",
)
def decision_snapshot(spark, d):
    return H.decision_entries(_scored(spark, d), "추가 검토", " 근거\n", F.lit("2026-01-01T09:00:00+09:00"))


@query(
    "normalize_ws",
    f"""SELECT ord, {S.squeeze('"applicantNameAtDecision"')} AS applicant, {S.squeeze('"ipcNumberAtDecision"')} AS ipc FROM judgments""",
)
def normalize_ws(spark, d):
    return table(spark, d, "judgments").select(
        "ord", squeeze(F.col("applicantNameAtDecision")).alias("applicant"), squeeze(F.col("ipcNumberAtDecision")).alias("ipc")
    )


PHRASES = (
    ("반도체 식각 공정을 위한 장치", "반도체;식각;공정"), ("AI", "ai"), ("방법 및 장치", ""), ("12 345", ""),
    ("집적회로 설계", "집적회;설계"), ("반도체를 반도체", "반도체"), ("공정으로부터", "공정"), ("회로", "회로"),
    ("충전하고 충전하는", "충전"), ("세정함", "세정"),
)


@query(
    "keyword_extract",
    "SELECT * FROM (VALUES " + ", ".join(f"({S.quote(a)}, {S.quote(b)})" for a, b in PHRASES) + ") t(technology, keywords)",
)
def keyword_extract(spark, d):
    return spark.createDataFrame([(p, ";".join(keywords(p))) for p, _ in PHRASES], "technology string, keywords string")


XML = """<r:response xmlns:r="urn:x"><header><resultCode>00</resultCode><successYN>Y</successYN></header><body><items>
<item><inventionTitle/><applicationNumber>7</applicationNumber></item><item><Applicant>only</Applicant></item>
<r:PatentUtilityInfo><InventionName> A  <b>bold</b>
 x </InventionName><ApplicationNumber>1020200000001</ApplicationNumber></r:PatentUtilityInfo>
<PatentUtilityInfo><r:inventionTitle>T2</r:inventionTitle><ApplicationNumber>0020</ApplicationNumber><sub><Abstract>deep</Abstract></sub></PatentUtilityInfo>
</items></body></r:response>"""


@query(
    "parse_xml_rows",
    "SELECT * FROM (VALUES (0, 'A bold x', '1020200000001', ''), (1, 'T2', '0020', 'deep'), (2, '', '7', '')) t(pos, title, application_number, abstract)",
)
def parse_xml_rows(spark, d):
    from docketry.sources.xml_records import parse_records

    rows = parse_records(spark.createDataFrame([(XML,)], "body string"))
    return rows.select("pos", "title", "application_number", "abstract")


@query("xml_metadata", "SELECT '00' AS \"resultCode\", '' AS \"resultMsg\", 'Y' AS \"successYN\", 2 AS n_info, 2 AS n_item")
def xml_metadata(spark, d):
    from docketry.sources.xml_records import response_metadata

    return response_metadata(spark.createDataFrame([(XML,)], "body string"))


@query("rest_search", "SELECT * FROM (VALUES ('battery', 0, 'A bold x'), ('battery', 1, 'T2'), ('battery', 2, '')) t(word, pos, title)")
def rest_search(spark, d):
    from docketry.sources.rest import search

    return search(spark, "battery", saved=XML).select("word", "pos", "title")


@query("json_log_scan", "SELECT * FROM (VALUES (0::BIGINT, '1', 7.5::DOUBLE), (3::BIGINT, '2', NULL)) t(ord, application_number, score)")
def json_log_scan(spark, d):
    from docketry.sources.json_log import parse_log

    text = '[{"applicationNumber":"1","relevanceScoreAtDecision":7.5},5,"s",{"applicationNumber":"2"}]'
    rows = parse_log(spark.createDataFrame([(text,)], "value string"))
    return rows.select("ord", F.col("applicationNumber").alias("application_number"), F.col("relevanceScoreAtDecision").alias("score"))


@query(
    "mask_secret",
    r"""SELECT ord, regexp_replace('x?accessKey = ' || ord || '&serviceKey:' || coalesce(nullif(trim("decisionReason"), ''), 'none') || '&a=1',
      '(accessKey|serviceKey)(\s*[=:]\s*)[^&\s<>"'']+', '\1\2[REDACTED]', 'gi') AS masked FROM judgments""",
)
def mask_secret(spark, d):
    reason = F.coalesce(F.nullif(F.trim("decisionReason"), F.lit("")), F.lit("none"))
    text = F.concat(F.lit("x?accessKey = "), F.col("ord").cast("string"), F.lit("&serviceKey:"), reason, F.lit("&a=1"))
    return table(spark, d, "judgments").select("ord", mask_secrets(text).alias("masked"))


@query(
    "csv_roundtrip",
    f"{S.scored(ALL)} SELECT application_number, {S.squeeze('title')} AS title, {S.squeeze('applicant')} AS applicant, {S.squeeze('ipc')} AS ipc, score_reason, relevance_score FROM scored",
)
def csv_roundtrip(spark, d):
    import uuid

    from docketry.sinks.csv import read_csv, write_csv

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    # White space is squeezed as the response parser does it, so no field holds a line break.
    clean = {c: squeeze(F.col(c)) for c in ("title", "applicant", "ipc", "abstract")}
    write_csv(_scored(spark, d).withColumns(clean), path, single_file=False)
    back = read_csv(spark, path)
    return back.select(
        F.col("출원번호").alias("application_number"), F.col("발명의 명칭").alias("title"), F.col("출원인").alias("applicant"),
        F.col("IPC").alias("ipc"), "score_reason", F.col("relevance_score").cast("double"),
    )


@query(
    "badge",
    f"""{S.scored(ALL)} SELECT ord, CASE review_priority WHEN '{C.PRIORITY_HIGH}' THEN '🔴 ' WHEN '{C.PRIORITY_MEDIUM}' THEN '🟠 ' ELSE '🟢 ' END || review_priority AS badge FROM scored""",
)
def badge_q(spark, d):
    return _scored(spark, d).select("ord", badge(F.col("review_priority")).alias("badge"))


# Problem 2: what changed between full snapshots.

_STATES = f"""raw AS (SELECT snapshot_no, loaded_at, {S.digits('"applicationNumber"')} AS k,
    {S.squeeze('"registerStatus"')} AS s, {S.squeeze('"applicantName"')} AS a FROM patent_snapshots WHERE snapshot_no IS NOT NULL),
  states AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_no, k ORDER BY loaded_at DESC NULLS LAST, s DESC, a DESC) AS rn
    FROM raw WHERE k IS NOT NULL) WHERE rn = 1),
  nums AS (SELECT snapshot_no AS cur, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM raw)),
  pairs AS (SELECT n.cur, coalesce(c.k, p.k) AS k, c.k AS ck, p.k AS pk, c.s AS cs, p.s AS ps, c.a AS ca, p.a AS pa
    FROM (SELECT n.cur, n.prev, s.k, s.s, s.a FROM nums n JOIN states s ON s.snapshot_no = n.cur WHERE n.prev IS NOT NULL) c
    FULL JOIN (SELECT n.cur, s.k, s.s, s.a FROM nums n JOIN states s ON s.snapshot_no = n.prev) p ON c.cur = p.cur AND c.k = p.k
    CROSS JOIN LATERAL (SELECT coalesce(c.cur, p.cur) AS cur) n)"""


@query(
    "p2_found",
    f"""WITH {_STATES} SELECT cur AS snapshot_no, k AS application_number,
      CASE WHEN pk IS NULL THEN 'added' WHEN ck IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM pairs WHERE pk IS NULL OR ck IS NULL OR cs <> ps OR ca <> pa""",
)
def p2_found(spark, d):
    return snapshot_changes(table(spark, d, "patent_snapshots")).drop("changed_fields")


@query(
    "p2_changed_fields",
    f"""WITH {_STATES} SELECT cur AS snapshot_no, k AS application_number, field_name FROM (
      SELECT cur, k, 'registerStatus' AS field_name FROM pairs WHERE cs <> ps UNION ALL
      SELECT cur, k, 'applicantName' AS field_name FROM pairs WHERE ca <> pa)""",
)
def p2_changed_fields(spark, d):
    changes = snapshot_changes(table(spark, d, "patent_snapshots"))
    return changes.select("snapshot_no", "application_number", F.explode("changed_fields").alias("field_name"))


# Problem 3: history of changing attributes.

_VERSIONS = f"""WITH e AS (SELECT ord, {S.digits('"applicationNumber"')} AS k,
    epoch(try_cast(trim("decisionTime") AS TIMESTAMPTZ))::BIGINT AS ts,
    {S.squeeze('"registerStatusAtDecision"')} AS s, {S.squeeze('"applicantNameAtDecision"')} AS a, {S.squeeze('"ipcNumberAtDecision"')} AS i FROM judgments),
  one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, ts ORDER BY ord NULLS LAST, s, a, i) AS rn FROM e
    WHERE k IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1),
  marked AS (SELECT *, lag(s || chr(1) || a || chr(1) || i) OVER (PARTITION BY k ORDER BY ts) AS before FROM one)"""


@query(
    "p3_found",
    f"""{_VERSIONS} SELECT k AS application_number, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY k ORDER BY ts), 0) AS valid_to
    FROM marked WHERE before IS DISTINCT FROM s || chr(1) || a || chr(1) || i""",
)
def p3_found(spark, d):
    return versions(table(spark, d, "judgments")).select("application_number", "valid_from", "valid_to")


@query(
    "p3_history",
    f"""{_VERSIONS} SELECT k AS application_number, ts AS valid_from, coalesce(lead(ts) OVER (PARTITION BY k ORDER BY ts), 0) AS valid_to,
      s AS register_status, a AS applicant, i AS ipc FROM marked WHERE before IS DISTINCT FROM s || chr(1) || a || chr(1) || i""",
)
def p3_history(spark, d):
    return versions(table(spark, d, "judgments")).select(
        "application_number", "valid_from", "valid_to", F.col("registerStatusAtDecision").alias("register_status"),
        F.col("applicantNameAtDecision").alias("applicant"), F.col("ipcNumberAtDecision").alias("ipc"),
    )


# Problem 5: several codes in one field.

_CODE_SQL = r"[A-HY]\d{2}[A-Z]\d{10}|[A-HY]\d{2}[A-Z][\s\-]*\d{1,4}\s*/\s*\d{2,6}|[A-HY]\d{2}[A-Z]|\d{1,4}\s*/\s*\d{2,6}"


@query(
    "p5_found",
    f"""WITH t AS (SELECT rec_id, regexp_extract_all(regexp_replace(upper(coalesce("ipcNumber", '')), '\\([^()]*\\)', ' ', 'g'), '{_CODE_SQL}') AS codes FROM patent_utility_info),
    u AS (SELECT rec_id, unnest(codes) AS c, generate_subscripts(codes, 1) AS p FROM t),
    v AS (SELECT rec_id, p, regexp_replace(c, '[\\s\\-]', '', 'g') AS c FROM u),
    w AS (SELECT rec_id, p, c, last_value(CASE WHEN regexp_matches(c, '^[A-Z]') THEN substr(c, 1, 4) END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY p) AS sub FROM v),
    x AS (SELECT rec_id, p, sub || CASE WHEN regexp_matches(c, '^[A-Z]\\d\\d[A-Z]\\d{{10}}$')
        THEN ' ' || (substr(c, 5, 4)::INT)::VARCHAR || '/' || regexp_replace(substr(c, 9, 6), '^(..+?)0*$', '\\1')
      WHEN contains(c, '/') THEN ' ' || regexp_extract(c, '(\\d+/\\d+)$', 1) ELSE '' END AS ipc_code FROM w WHERE sub IS NOT NULL)
    SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY p)::INT AS pos, ipc_code FROM x""",
)
def p5_found(spark, d):
    return unpack_codes(table(spark, d, "patent_utility_info"))


_MARKS = {"semicolon": ";", "bar": r"\|", "comma": ",", "line": r"[\r\n]+", "dot": "·", "slash": "／", "list number": r"(?:^|\s)\d{1,2}\)"}
_BLANKS = (r"(§)[ \t]+([^\s;|,·／\d])", r"([^\s;|,·／)])[ \t]+(§)")
_OUTER = r"^(?:[\s;|,·／]|\d{1,2}\)\s)+|[\s;|,·／]+$"


def _pieces_sql(names: list[str]) -> str:
    cut = "shape"
    for name in names:
        if name == "blank":
            for pattern in _BLANKS * 2:
                cut = f"regexp_replace({cut}, '{pattern}', '\\1' || chr(1) || '\\2', 'g')"
        else:
            cut = f"regexp_replace({cut}, '{_MARKS[name]}', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda p: regexp_replace(p, '{_OUTER}', '', 'g')), lambda p: p <> '')"


_EVERY = [*_MARKS, "blank"]
_SCORES = " UNION ALL ".join(
    f"""SELECT source, layout, '{name}' AS delimiter, n, len(list_filter(every, lambda p: p = '§')) AS codes,
      len(every) AS pieces, len(list_filter(every, lambda p: p = '§' OR NOT regexp_matches(p, '[\\d§]'))) AS typed,
      len({_pieces_sql([name])}) > 1 AS cuts, len(list_filter({_pieces_sql([x for x in _EVERY if x != name])}, lambda p: p = '§')) AS without
    FROM shapes WHERE list_contains(string_split(layout, '+'), '{name}')"""
    for name in _EVERY
)
_HAS = ", ".join(f"CASE WHEN regexp_matches(shape, '{p}') THEN '{n}' END" for n, p in {**_MARKS, "blank": "|".join(_BLANKS)}.items())


@query(
    "p5_delimiters",
    f"""WITH t AS (SELECT source, regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(coalesce("ipcNumber", '')), '\\([^()]*\\)', ' ', 'g'),
        '\\([^()]*$', ' ', 'g'), '["''“”‘’\\[\\]{{}}]', '', 'g'), '{_OUTER}', '', 'g') AS text FROM patent_utility_info),
    s AS (SELECT source, regexp_replace(text, '{_CODE_SQL}', '§', 'g') AS shape FROM t),
    l AS (SELECT source, shape, array_to_string(list_filter([{_HAS}], lambda x: x IS NOT NULL), '+') AS layout FROM s),
    shapes AS (SELECT source, layout, shape, count(*) AS n, {_pieces_sql(_EVERY)} AS every FROM l WHERE layout <> '' GROUP BY ALL),
    scores AS ({_SCORES})
    SELECT source, layout, delimiter, sum(n)::BIGINT AS n_values, sum(CASE WHEN cuts THEN n ELSE 0 END) / sum(n) AS consistency,
      sum(n * typed) / greatest(sum(n * pieces), 1) AS regularity, sum(n * (codes - without))::BIGINT AS gain,
      consistency >= 0.5 AND regularity >= 0.5 AND gain > 0 AS accepted FROM scores GROUP BY source, layout, delimiter""",
)
def p5_delimiters(spark, d):
    return delimiter_scores(table(spark, d, "patent_utility_info"))
