"""Configuration of the scoring engine. Every value can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

# Record columns (public name, internal name, accepted XML tags).
RECORD_FIELDS = (
    ("발명의 명칭", "title", ("InventionName", "inventionTitle")),
    ("출원번호", "application_number", ("ApplicationNumber", "applicationNumber")),
    ("출원인", "applicant", ("Applicant", "applicantName")),
    ("IPC", "ipc", ("InternationalpatentclassificationNumber", "ipcNumber")),
    ("등록상태", "register_status", ("RegistrationStatus", "registerStatus")),
    ("초록", "abstract", ("Abstract", "astrtCont")),
)
ASSESSMENT_COLUMNS = (
    "relevance_score",
    "review_priority",
    "matched_concepts",
    "score_reason",
    "analysis_mode",
)

# Labels and messages.
PRIORITY_HIGH = "검토 우선순위 높음"
PRIORITY_MEDIUM = "검토 우선순위 보통"
PRIORITY_LOW = "검토 우선순위 낮음"
PRIORITY_BADGES = {PRIORITY_HIGH: "🔴", PRIORITY_MEDIUM: "🟠", PRIORITY_LOW: "🟢"}
PRIORITY_BADGE_DEFAULT = "⚪"
REVIEW_CHOICES = ("관련 있음", "관련 없음", "추가 검토")
GENERIC_NOTICE = (
    "사전 정의된 기술 개념 그룹이 없어 입력된 평가 기술어를 기반으로 범용 키워드 분석을 수행했습니다."
)
NO_KEYWORD_REASON = "의미 있는 키워드를 추출하지 못해 0점 처리"
NO_GROUP_REASON = "평가 기술어에 기본 개념 그룹이 없음"
NO_CONCEPT_REASON = "평가 개념을 제목·초록·IPC에서 찾지 못함"
NO_HIT_REASON = "제목·초록에서 키워드를 찾지 못함"
MODE_CONCEPT = "concept_group"
MODE_GENERIC = "generic_keyword"
STATE_NONE = "검토 기록 없음"
STATE_CHANGED = "재검토 필요"
STATE_SAME = "현재 확인된 주요 특허정보 변화 없음"
EMPTY_SNAPSHOT = "(저장된 값 없음)"
UNTITLED = "명칭 없음"

# Concept groups.
CONCEPT_GROUPS = {
    "vehicle": ("전기차", "전기 자동차", "차량", "자동차"),
    "battery": ("배터리",),
    "cooling": ("냉각", "열관리", "온도관리", "수냉", "냉각수", "냉매", "열교환"),
}
CONCEPT_NAMES = {"vehicle": "차량", "battery": "배터리", "cooling": "냉각"}

# Suffixes and stop words of the keyword extraction, in the order they are tried.
VERB_ENDINGS = (
    "하여서", "하면서", "하는", "하기", "하며", "하고", "한다", "된다", "되는", "되고", "하여", "함",
)
PARTICLES = (
    "으로부터", "에게서", "에서는", "으로", "에게", "한테", "부터", "까지", "처럼", "보다", "이랑", "하고",
    "이나", "라도", "마저", "조차", "은", "는", "이", "가", "을", "를", "의", "에", "로", "와", "과", "도",
    "만", "랑", "께",
)
STOP_WORDS = frozenset(
    ("기술", "방법", "시스템", "장치", "구조", "관련", "분야", "위한", "대한", "통한", "특허", "및", "또는",
     "그리고", "등", "각", "본", "여러")
)


@dataclass(frozen=True)
class ScoringConfig:
    """Weights, thresholds and word lists. The defaults are fixed values: the published scoring table."""

    groups: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(CONCEPT_GROUPS))
    names: dict[str, str] = field(default_factory=lambda: dict(CONCEPT_NAMES))
    title_weights: dict[str, int] = field(
        default_factory=lambda: {"vehicle": 3, "battery": 4, "cooling": 6}
    )
    abstract_weights: dict[str, int] = field(
        default_factory=lambda: {"vehicle": 2, "battery": 2, "cooling": 3}
    )
    both_core_bonus: int = 65
    single_core_bonus: int = 25
    vehicle_bonus: int = 5
    ipc_bonus: int = 2
    cap: int = 100
    generic_title_weight: int = 4
    generic_abstract_weight: int = 2
    generic_multi_bonus: int = 3
    generic_ipc_weight: int = 1
    high_min: float = 70
    medium_min: float = 40
    ipc_families: tuple[tuple[str, str], ...] = (("H01M", "battery"), ("B60L", "vehicle"))
    fallback: str = "generic"  # or "none": score 0 where no concept group is targeted
    verb_endings: tuple[str, ...] = VERB_ENDINGS
    particles: tuple[str, ...] = PARTICLES
    stop_words: frozenset[str] = STOP_WORDS
