"""Building blocks of the reference SQL (DuckDB dialect) that checks the queries."""

from __future__ import annotations

from docketry import config as C
from docketry.config import ScoringConfig
from docketry.plans.tables import RECORDS_SQL

SPACE = r"[\s\v\x1c-\x1f\x85\p{Z}]+"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}', ' ', 'g'))"


def digits(x: str) -> str:
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"CASE WHEN length({d}) = 13 THEN {d} END"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_phrase(col: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {quote(p)})" for p in phrases) + ")"


def family(code: str) -> str:
    compact = f"regexp_replace(upper(ipc), '{SPACE}', '', 'g')"
    return f"regexp_matches({compact}, '(^|[^A-Z0-9]){code}([0-9/]|$)')"


def band(score: str) -> str:
    return (
        f"CASE WHEN {score} >= 70 THEN '{C.PRIORITY_HIGH}' WHEN {score} >= 40 THEN '{C.PRIORITY_MEDIUM}' "
        f"ELSE '{C.PRIORITY_LOW}' END"
    )


def hits(groups) -> str:
    """CTE ``hits``: records with the presence flags; untargeted groups are false."""
    cfg = ScoringConfig()
    flags = []
    for g in cfg.groups:
        for short, col in (("t", "title"), ("a", "abstract")):
            test = any_phrase(col, cfg.groups[g]) if g in groups else "false"
            flags.append(f"{test} AS {short}_{g}")
    flags.append((family("H01M") if "battery" in groups else "false") + " AS f_h")
    flags.append((family("B60L") if "vehicle" in groups else "false") + " AS f_b")
    return f"{RECORDS_SQL}, hits AS (SELECT *, {', '.join(flags)} FROM records)"


SCORE = """CAST(3*t_vehicle::int + 4*t_battery::int + 6*t_cooling::int
  + 2*a_vehicle::int + 2*a_battery::int + 3*a_cooling::int
  + CASE WHEN (t_battery OR a_battery) AND (t_cooling OR a_cooling) THEN 65
         WHEN t_battery OR a_battery OR t_cooling OR a_cooling THEN 25 ELSE 0 END
  + CASE WHEN t_vehicle OR a_vehicle THEN 5 ELSE 0 END + 2*f_h::int + 2*f_b::int AS DOUBLE)"""

MATCHED = """concat_ws(';', CASE WHEN t_vehicle OR a_vehicle THEN 'vehicle' END,
  CASE WHEN t_battery OR a_battery THEN 'battery' END, CASE WHEN t_cooling OR a_cooling THEN 'cooling' END,
  CASE WHEN f_h THEN 'IPC:H01M' END, CASE WHEN f_b THEN 'IPC:B60L' END)"""


def _names(short: str, before: str) -> str:
    names = f"concat_ws('·', CASE WHEN {short}_vehicle THEN '차량' END, CASE WHEN {short}_battery THEN '배터리' END, CASE WHEN {short}_cooling THEN '냉각' END)"
    return f"CASE WHEN {short}_vehicle OR {short}_battery OR {short}_cooling THEN '{before}' || {names} || ' 발견' END"


REASON = f"""coalesce(nullif(concat_ws(', ',
  CASE WHEN (t_battery OR a_battery) AND (t_cooling OR a_cooling) THEN '배터리·냉각 개념 모두 확인'
       WHEN t_battery OR a_battery THEN '배터리 개념 확인' WHEN t_cooling OR a_cooling THEN '냉각 개념 확인' END,
  CASE WHEN t_vehicle OR a_vehicle THEN '차량 개념 확인' END,
  {_names('t', '제목에서 ')}, {_names('a', '초록에서 ')},
  CASE WHEN f_h OR f_b THEN concat_ws('/', CASE WHEN f_h THEN 'H01M' END, CASE WHEN f_b THEN 'B60L' END) || ' IPC 확인' END
), ''), '{C.NO_CONCEPT_REASON}')"""


def scored(groups) -> str:
    """CTE ``scored``: records with score, band, matched concepts and reason."""
    return (
        f"WITH {hits(groups)}, scored AS (SELECT ord, title, application_number, applicant, ipc, register_status, "
        f"{SCORE} AS relevance_score, {band(SCORE)} AS review_priority, {MATCHED} AS matched_concepts, "
        f"{REASON} AS score_reason FROM hits)"
    )


def generic(words: list[str]) -> str:
    """CTE ``g``: records scored by literal keywords."""
    best = 6 * len(words) + (3 if len(words) > 1 else 0) + 2
    flags = ", ".join(
        f"contains(lower(title), {quote(w)}) AS t{i}, contains(lower(abstract), {quote(w)}) AS a{i}"
        for i, w in enumerate(words)
    )
    n = range(len(words))
    several = "(" + " + ".join(f"(t{i} OR a{i})::int" for i in n) + ") >= 2"
    points = (
        " + ".join(f"4*t{i}::int + 2*a{i}::int" for i in n)
        + f" + CASE WHEN {several} THEN 3 ELSE 0 END + f_h::int + f_b::int"
    )
    score = f"round(100.0::DOUBLE * ({points}) / {best}::DOUBLE, 1)"
    found = ", ".join(f"CASE WHEN t{i} THEN {quote(words[i])} END" for i in n)
    rest = ", ".join(f"CASE WHEN a{i} AND NOT t{i} THEN {quote(words[i])} END" for i in n)
    in_t = ", ".join(f"CASE WHEN t{i} THEN {quote(words[i])} END" for i in n)
    in_a = ", ".join(f"CASE WHEN a{i} THEN {quote(words[i])} END" for i in n)
    reason = (
        f"coalesce(nullif(concat_ws(', ', '제목 키워드: ' || nullif(concat_ws('·', {in_t}), ''), "
        f"'초록 키워드: ' || nullif(concat_ws('·', {in_a}), ''), CASE WHEN {several} THEN '복수 키워드 동시 발견 (+3점)' END, "
        f"CASE WHEN f_h OR f_b THEN 'IPC 보조 확인: ' || concat_ws('/', CASE WHEN f_h THEN 'H01M' END, CASE WHEN f_b THEN 'B60L' END) END), ''), '{C.NO_HIT_REASON}')"
    )
    return (
        f"WITH {RECORDS_SQL}, k AS (SELECT *, {flags}, {family('H01M')} AS f_h, {family('B60L')} AS f_b FROM records), "
        f"g AS (SELECT ord, {score} AS relevance_score, {band(score)} AS review_priority, "
        f"concat_ws(';', {found}, {rest}) AS matched_concepts, {reason} AS score_reason FROM k)"
    )


LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "applicationNumber" ORDER BY coalesce("decisionTime", '') DESC, ord) AS rn,
      count(*) OVER (PARTITION BY "applicationNumber") AS n_entries
    FROM judgments WHERE coalesce("applicationNumber", '') <> '') WHERE rn = 1)"""


def compared() -> str:
    """CTE ``diffs``: records with their latest entry and both sides of each compared field."""
    pairs = ", ".join(
        f"{squeeze('l.' + chr(34) + stored + chr(34))} AS p{i}, {squeeze('r.' + current)} AS c{i}"
        for i, (stored, current) in enumerate(
            (("registerStatusAtDecision", "register_status"), ("applicantNameAtDecision", "applicant"), ("ipcNumberAtDecision", "ipc"))
        )
    )
    return (
        f"WITH {RECORDS_SQL}, {LATEST}, diffs AS (SELECT r.ord, r.application_number, l.n_entries, l.decision, "
        f"l.\"decisionTime\" AS latest_time, {pairs} FROM records r LEFT JOIN latest l ON r.application_number = l.\"applicationNumber\")"
    )
