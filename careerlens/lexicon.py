"""Term lists, weights and policies.

Every list is a field of a dataclass so that a caller can swap in another
vocabulary; the module constants hold the default values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# The terms, weights and limits below must equal the defaults of
# the system whose results this package reproduces. They are data, not logic.
# ---------------------------------------------------------------------------

# Links whose address holds one of these are never postings (keyword scan).
LINK_URL_EXCLUSIONS = (
    "javascript:", "mailto:", "tel:", "#",
    "/about", "/contact", "/privacy", "/terms",
    "/login", "/signin", "/signup", "/register",
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com",
    ".pdf", ".jpg", ".png", ".gif",
)
LINK_MIN_TEXT = 10

# Elements that hold posting links (keyword scan): tag and class fragment.
CONTAINER_TAGS = ("article", "div")
CONTAINER_CLASS_TERMS = ("job", "position", "career", "opening")

# Candidate checks of the scored scan.
CANDIDATE_URL_EXCLUSIONS = (
    "/login", "/signin", "/signup", "/register",
    "/about", "/contact", "/privacy", "/terms",
    "/blog", "/news", "/press", "/media", "/article",
    "/people/", "/employee/", "/staff/", "/team/",
    "/companies", "/directory",
    "/search", "/filter", "/browse",
    "facebook.com", "twitter.com", "linkedin.com/company",
    "instagram.com", "youtube.com",
    ".pdf", ".jpg", ".png", ".gif",
    "javascript:", "mailto:", "tel:", "#",
    "/financial", "/investor", "/ir/", "/coverage",
    "/guidelines", "/application", "/apply-guide",
)
CANDIDATE_TEXT_EXCLUSIONS = (
    "sign up", "sign in", "login", "logout", "register", "create account",
    "newsletter", "subscribe", "unsubscribe",
    "search jobs", "browse jobs", "view all", "see all", "show more",
    "filter", "sort by", "refine search",
    "about us", "about", "contact", "contact us", "help", "faq",
    "privacy", "terms", "cookie", "legal",
    "blog", "news", "press", "media",
    "pricing", "plans", "features",
    "companies", "top companies", "company directory",
    "resources", "guides", "tips", "advice",
    "experiences", "stories", "testimonials",
    "twitter", "facebook", "linkedin", "instagram",
    "youtube", "github", "discord", "slack",
    "remote companies", "designer experiences",
    "developer jobs", "japan developer",
)
SKIP_TITLE_TERMS = (
    "learn more", "guidelines for application", "mid-career", "kpi trends",
    "financial statement", "analyst coverage", "message from", "in the spotlight",
    "story:", "search job openings", "employee conditions", "manual check recommended",
)
BUTTON_LABELS = (
    "learn more", "read more", "view", "see all", "apply now", "join us",
    "explore", "discover", "find out", "click here", "details",
    "view job", "view jobs", "see jobs", "browse", "search",
)
CATEGORY_LABELS = (
    "engineering", "engineers", "developer", "developers",
    "new graduates", "students", "internship", "internships",
    "job categories", "all jobs", "open positions",
    "career opportunities", "join our team", "work with us",
    "manager jobs", "senior jobs", "junior jobs",
)
POSTING_URL_TERMS = (
    "/job/", "/jobs/", "/position/", "/positions/",
    "/career/", "/careers/", "/opening/", "/vacancy",
    "/role/", "/opportunity", "/requisition",
)
ROLE_TITLE_TERMS = (
    "engineer", "developer", "scientist", "analyst",
    "designer", "manager", "specialist", "architect",
    "intern", "graduate", "AI", "ML", "data", "software",
    "backend", "frontend", "full stack", "devops",
)
CANDIDATE_MIN_TITLE = 15
DEFAULT_LINK_CAP = 30
BOARD_LINK_CAP = 12
MIN_DETAIL_TEXT = 200

# Scoring vocabulary.
YEAR_TERMS = ("2026", "class of 2026")
GRADUATE_TERMS = (
    "graduate", "new grad", "fresh graduate", "entry level", "early career",
    "0-2 years", "recent graduate", "junior", "new graduate", "卒業",
)
DEAL_BREAKER_TERMS = (
    "PhD required", "doctorate required", "doctoral degree required",
    "must have PhD", "PhD is required", "PhD degree required",
    "5+ years required", "5+ years of experience required",
    "minimum 5 years", "at least 5 years",
    "10+ years", "7+ years", "minimum 10 years",
    "N1 required", "N1 certification required", "JLPT N1 required",
    "N2 required", "JLPT N2 required",
    "Japanese fluency required", "business level japanese required",
    "native japanese required", "native level japanese",
)
ENTRY_LEVEL_TERMS = (
    "new grad", "new graduate", "recent graduate",
    "entry level", "entry-level", "junior",
    "intern", "internship", "graduate program",
    "early career", "fresh graduate", "university graduate",
    "2025", "2026", "2027",
    "no experience required", "0-2 years",
    "新卒", "新入社員",
)
SENIORITY_WEIGHTS = (
    ("senior", -0.30),
    ("lead", -0.35),
    ("principal", -0.40),
    ("staff engineer", -0.40),
    ("manager", -0.35),
    ("director", -0.45),
    ("VP", -0.50),
    ("head of", -0.45),
    ("3+ years", -0.20),
    ("3-5 years", -0.20),
    ("minimum 3 years", -0.25),
    ("4+ years", -0.25),
    ("PhD preferred", -0.10),
    ("master preferred", -0.05),
    ("masters preferred", -0.05),
)
DOCTORATE_PREFERRED_TERMS = ("phd preferred", "doctoral preferred")
MASTERS_PREFERRED_TERMS = ("masters preferred", "master's preferred")
BACHELOR_TERMS = (
    "bachelor", "undergraduate", "bs degree", "b.s. degree",
    "bachelor's", "bachelors degree", "学士", "大学卒",
)
DOMAIN_TERMS = (
    "AI", "machine learning", "ML engineer", "artificial intelligence",
    "python", "pytorch", "tensorflow", "computer vision", "CV",
    "backend", "fastapi", "deep learning", "neural network",
    "LLM", "generative AI", "data science", "MLOps",
    "visa sponsorship", "english", "no japanese required",
)
ENGINEERING_TITLE_TERMS = (
    "engineer", "scientist", "developer", "researcher", "architect",
    "エンジニア", "開発", "研究",
)
SITE_TITLE_SCORE = 0.50
SITE_TEXT_THRESHOLD = 0.25
DEFAULT_THRESHOLD = 0.7

# Section titles (posting blocks inside one page).
SECTION_MARKER_TERMS = ("職種", "Software Engineer")
SECTION_ROLE_TERMS = (
    "Software Engineer", "AI Engineer", "Machine Learning Engineer",
    "Data Scientist", "Data Engineer", "Research Scientist",
    "Product Manager", "Project Manager", "Infra Engineer",
)
SECTION_DIVISION_TERMS = ("Company", "Inc.", "Division")
SECTION_MIN_TEXT = 100
SECTION_LINES = 15
SECTION_DIVISION_MAX = 80

# Snapshot life time, retention and title bounds.
SNAPSHOT_TTL_SECONDS = 3600
RETENTION_DAYS = 30
TITLE_MIN = 3
TITLE_MAX = 300

# Posting states, in display order.
PIPELINE_STATES = ("Pending", "CV Generated", "Applied", "Interview", "Offer", "Rejected")
# ------------------------------- end of fixed values ------------------------


@dataclass(frozen=True)
class LinkPolicy:
    """Which anchors of a listing page the keyword scan may keep."""

    url_exclusions: tuple[str, ...] = LINK_URL_EXCLUSIONS
    min_text: int = LINK_MIN_TEXT


@dataclass(frozen=True)
class CandidatePolicy:
    """Strict candidate test of the scored scan."""

    url_exclusions: tuple[str, ...] = CANDIDATE_URL_EXCLUSIONS
    text_exclusions: tuple[str, ...] = CANDIDATE_TEXT_EXCLUSIONS
    skip_title_terms: tuple[str, ...] = SKIP_TITLE_TERMS
    button_labels: tuple[str, ...] = BUTTON_LABELS
    category_labels: tuple[str, ...] = CATEGORY_LABELS
    posting_url_terms: tuple[str, ...] = POSTING_URL_TERMS
    role_terms: tuple[str, ...] = ROLE_TITLE_TERMS
    min_title: int = CANDIDATE_MIN_TITLE


@dataclass(frozen=True)
class SiteRule:
    """Per-company exceptions to :class:`CandidatePolicy` and the link cap."""

    company: str
    allow_text_contains: tuple[str, ...] = ()
    extra_url_patterns: tuple[str, ...] = ()
    bypass_title_skip: bool = False
    max_links: int | None = None


@dataclass(frozen=True)
class Lexicon:
    """Scoring vocabulary. ``required=()`` switches the required stage off."""

    required: tuple[str, ...] = YEAR_TERMS + GRADUATE_TERMS
    deal_breakers: tuple[str, ...] = DEAL_BREAKER_TERMS
    entry_level: tuple[str, ...] = ENTRY_LEVEL_TERMS
    penalties: tuple[tuple[str, float], ...] = SENIORITY_WEIGHTS
    doctorate_preferred: tuple[str, ...] = DOCTORATE_PREFERRED_TERMS
    masters_preferred: tuple[str, ...] = MASTERS_PREFERRED_TERMS
    bachelor: tuple[str, ...] = BACHELOR_TERMS
    domain: tuple[str, ...] = DOMAIN_TERMS
    step: float = 0.05
    entry_cap: float = 0.15
    domain_cap: float = 0.20
    doctorate_weight: float = -0.10
    masters_weight: float = -0.05
    bachelor_weight: float = 0.08
    penalty_mode: str = "first"  # or "strongest"


@dataclass(frozen=True)
class SourcePolicy:
    """How one kind of source is scored: threshold, link cap, required terms."""

    lexicon: Lexicon = field(default_factory=Lexicon)
    threshold: float = DEFAULT_THRESHOLD
    link_cap: int = DEFAULT_LINK_CAP


def board_policy(threshold: float = DEFAULT_THRESHOLD) -> SourcePolicy:
    """Aggregator boards: graduate terms only, shorter link list."""
    return SourcePolicy(Lexicon(required=GRADUATE_TERMS), threshold, BOARD_LINK_CAP)


@dataclass(frozen=True)
class SectionPolicy:
    """Vocabulary of the section-title assembly."""

    markers: tuple[str, ...] = SECTION_MARKER_TERMS
    roles: tuple[str, ...] = SECTION_ROLE_TERMS
    divisions: tuple[str, ...] = SECTION_DIVISION_TERMS
    min_text: int = SECTION_MIN_TEXT
    lines: int = SECTION_LINES
    division_max: int = SECTION_DIVISION_MAX
