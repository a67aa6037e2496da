"""Default rule tables. Every operator takes its rules as a parameter; these are only the defaults."""

from __future__ import annotations

import re
from typing import NamedTuple

# ---- fixed values: term dictionary -----------------------------------------------------------------------------
TECHNICAL_TERMS = (
    "Python", "SQL", "Java", "C++", "C#", "JavaScript", "TypeScript", "React", "Angular", "Vue",
    "HTML", "CSS", "PHP", "Laravel", "Ruby", "Rails", "Go", "Rust", "Swift", "Kotlin", "Scala",
    "Spark", "Hadoop", "Kafka", "Docker", "Kubernetes", "Git", "Jenkins", "Ansible", "Terraform",
    "AWS", "Azure", "GCP", "Google Cloud", "Salesforce", "Tableau", "Power BI", "Excel", "SAS",
    "R", "MATLAB", "SPSS", "Machine Learning", "Deep Learning", "NLP", "Computer Vision",
    "TensorFlow", "PyTorch", "Scikit-Learn", "Keras", "OpenCV", "LangChain", "Agentic AI", "LLM",
    "OpenAI", "Generative AI", "Hugging Face", "MongoDB", "PostgreSQL", "MySQL", "SQLite", "Oracle",
    "Redis", "Elasticsearch", "Redshift", "Snowflake", "BigQuery", "DynamoDB", "Cassandra",
    "Flask", "Django", "FastAPI", "Spring Boot", "Node.js", "Express", "GraphQL", "Haskell", "COBOL",
    "Fortran", "ABAP", "SAP", "Informatica", "Linux", "Unix", "Bash", "Shell", "PowerShell",
    "RightAngle", "AS400", "RPGLE", "CLP", "DB2", "PL/SQL", "T-SQL", "SSIS", "SSAS", "SSRS",
    "CICS", "JCL", "Mainframe", "Web Dynpro", "Fiori", "HANA", "Basis", "GRC",
)

SOFT_TERMS = (
    "Communication", "Leadership", "Agile", "Scrum", "Teamwork", "Collaboration", "Problem Solving",
    "Analytical Skills", "Critical Thinking", "Project Management", "Time Management", "Creativity",
    "Adaptability", "Negotiation", "Mentoring", "Presentation", "Interpersonal Skills", "Decision Making",
)

# ---- fixed values: terms whose written form has an optional ending, or that the list above lacks ------------------
OPTIONAL_ENDING = {"Vue.js": ("Vue", ".js"), "Node.js": ("Node", ".js"), "React.js": ("React", ".js")}
EXTRA_TECHNICAL_TERMS = (".NET", "Vue.js", "React.js")

# ---- fixed values: role categories, tested in this order -----------------------------------------------------------
ROLE_RULES = (
    ("Data Scientist", ("data scientist", "machine learning", "ml engineer", "deep learning", "nlp engineer",
                        "ai scientist")),
    ("Data Analyst", ("data analyst", "business intelligence", "bi analyst", "analytics", "reporting analyst",
                      "data visualization")),
    ("Business Analyst", ("business analyst", "systems analyst", "product analyst", "operations analyst")),
    ("Data Engineer", ("data engineer", "data architect", "database engineer", "etl developer",
                       "big data engineer")),
    ("Software Engineer", ("developer", "engineer", "programmer", "full stack", "frontend", "backend",
                           "web developer", "coder")),
    ("Devops", ("devops", "sre", "cloud engineer", "system administrator", "infrastructure")),
    ("Management", ("manager", "director", "lead", "head of", "scrum master", "product manager",
                    "project manager")),
)
ROLE_DEFAULT = "Other"

# ---- fixed values: work modes, tested in this order ---------------------------------------------------------------
MODE_RULES = (
    ("Remote", ("remote", "work from home", "wfh")),
    ("Hybrid", ("hybrid", "flexible work", "partially remote")),
)
MODE_DEFAULT = "Onsite"

# ---- fixed values: currency of a country name, tested in this order, and rates to USD ----------------------------
CURRENCY_RULES = (
    ("GBP", ("united kingdom", "uk", "gb")),
    ("USD", ("united states", "us", "usa")),
    ("CAD", ("canada", "ca")),
    ("AUD", ("australia", "au")),
    ("EUR", ("europe", "germany", "france")),
)
CURRENCY_DEFAULT = "INR"
USD_RATES = {"INR": 0.012, "GBP": 1.28, "USD": 1.0, "EUR": 1.08, "CAD": 0.73, "AUD": 0.66}

# ---- fixed values: experience buckets of the compensation matrix, in display order -------------------------------
EXPERIENCE_BUCKETS = ("Entry-Level (<2 yrs)", "Mid-Level (2-5 yrs)", "Senior-Level (>5 yrs)", "Not Specified")

# ---- fixed values: defaults of the ingest side ---------------------------------------------------------------------
ENVELOPE_KEYS = ("results", "jobs", "data", "postings")
TEXT_KEYS = ("display_name", "name", "title", "value")
DEFAULT_COUNTRY = "India"
DEFAULT_COMPANY = "Unknown"
MISSING = "N/A"
MISSING_DESCRIPTION = "No description provided."
MARKET_COUNTRIES = {"in": "India"}
OTHER_MARKET_COUNTRY = "United Kingdom"


class Term(NamedTuple):
    """One dictionary entry: the tag, its type, and the literal that must occur (plus an optional ending)."""

    name: str
    kind: str
    stem: str
    ending: str = ""


def default_terms() -> list[Term]:
    """The dictionary as a list of terms, each name once per type."""
    technical = dict.fromkeys(TECHNICAL_TERMS + EXTRA_TECHNICAL_TERMS)
    terms = [Term(name, "technical", *OPTIONAL_ENDING.get(name, (name, ""))) for name in technical]
    return terms + [Term(name, "soft", name) for name in dict.fromkeys(SOFT_TERMS)]


#: What counts as a word character on both sides of a whole-word match.
WORD = r"[\p{L}\p{N}_]"


def whole_word(stem: str, ending: str = "") -> str:
    """Java pattern for ``stem`` (with an optional ``ending``) as a whole word, ignoring case.

    A word edge needs a change of kind: next to a letter, digit or underscore the neighbour must not be one; next to
    any other character (the ``#`` of ``C#``) the neighbour must be one.
    """
    def literal(text: str) -> str:
        return re.sub(r"([^\w\s])", r"\\\1", text)

    def is_word(char: str) -> bool:
        return char.isalnum() or char == "_"

    def edge_after(text: str) -> str:
        return f"(?!{WORD})" if is_word(text[-1]) else f"(?={WORD})"

    before = f"(?<!{WORD})" if is_word(stem[0]) else f"(?<={WORD})"
    if not ending:
        return f"(?iu){before}{literal(stem)}{edge_after(stem)}"
    return f"(?iu){before}{literal(stem)}(?:{literal(ending)}{edge_after(ending)}|{edge_after(stem)})"
