"""Default word lists, patterns, weights and thresholds.

Every operator takes these as arguments, so a caller can pass its own lists.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# Fixed values. Results depend on each entry (and, where noted, on its order).
# ---------------------------------------------------------------------------

# Seniority level by substring of a job title; 2 is the floor and the default.
SENIORITY_LEVELS = {
    "intern": 0, "junior": 1, "associate": 1, "entry": 1, "mid": 2,
    "senior": 3, "lead": 4, "principal": 5, "staff": 5, "director": 6,
    "vp": 7, "head": 6, "chief": 8, "cto": 8, "ceo": 8,
}
SENIORITY_FLOOR = 2

# Company head-count bands, smallest first; anything else is 0.
COMPANY_SIZES = (
    "1-10", "11-50", "51-200", "201-500",
    "501-1000", "1001-5000", "5001-10000", "10001+",
)

PROFICIENCY_LEVELS = {"beginner": 1, "intermediate": 2, "advanced": 3, "expert": 4}
STRONG_PROFICIENCIES = ("advanced", "expert")

# Degree keyword -> level. The first keyword found in a degree decides (order matters).
DEGREE_LEVELS = {
    "bachelor": 1, "b.tech": 1, "b.e.": 1, "b.sc": 1, "bsc": 1, "ba": 1, "bba": 1,
    "master": 2, "m.tech": 2, "m.e.": 2, "m.sc": 2, "msc": 2, "mba": 2, "ma": 2,
    "phd": 3, "ph.d": 3, "doctorate": 3, "doctor": 3,
}
INSTITUTION_TIERS = {"tier_1": 1, "tier_2": 2, "tier_3": 3}
LOWEST_TIER = 4

TECH_FIELDS = ("computer", "software", "engineering", "data", "mathematics",
               "statistics", "physics", "information", "artificial", "machine")
TECH_TITLE_TERMS = ("engineer", "developer", "scientist", "analyst", "ml", "ai")

# Job text: competency mentions, matched without case and without word boundaries.
COMPETENCY_PATTERNS = (
    # models and language
    r"(?:large\s+)?language\s+model", r"LLM", r"transformer",
    r"NLP", r"natural\s+language", r"GPT", r"BERT", r"embedding",
    r"RAG", r"retrieval", r"vector\s+(?:search|database|store)",
    r"FAISS", r"Pinecone", r"Milvus", r"Weaviate", r"Chroma",
    r"LangChain", r"LlamaIndex", r"fine[\s-]?tun",
    r"LoRA", r"PEFT", r"prompt\s+engineering",
    r"machine\s+learning", r"deep\s+learning", r"neural\s+network",
    r"TensorFlow", r"PyTorch", r"scikit[\s-]?learn",
    r"reinforcement\s+learning", r"computer\s+vision",
    # programming
    r"Python", r"Java(?:Script)?", r"TypeScript", r"Go(?:lang)?",
    r"Rust", r"C\+\+", r"SQL", r"NoSQL",
    # infrastructure
    r"Docker", r"Kubernetes", r"AWS", r"GCP", r"Azure",
    r"Spark", r"Kafka", r"Airflow", r"MLflow",
    # evaluation
    r"evaluation", r"metric", r"NDCG", r"MAP", r"MRR",
    r"A/B\s+test", r"benchmark",
    # data
    r"data\s+engineer", r"data\s+pipeline", r"ETL",
    r"data\s+warehouse", r"Snowflake", r"dbt",
)

# Job text: what makes a section required or preferred.
REQUIRED_SECTION_WORDS = ("required", "must", "essential", "responsibilities")
PREFERRED_SECTION_WORDS = ("preferred", "nice", "bonus", "plus")
REQUIREMENT_PATTERNS = (
    r"must\s+have", r"required", r"essential", r"mandatory",
    r"strong\s+(?:experience|knowledge|skills)", r"proficien",
    r"you\s+(?:will|should|need)", r"expect(?:ed)?",
)
PREFERRED_PATTERNS = (
    r"nice\s+to\s+have", r"prefer(?:red|ably)?", r"bonus",
    r"advantag", r"ideal(?:ly)?", r"plus",
)
DISQUALIFIER_PATTERNS = (
    r"not\s+looking", r"do\s+not", r"avoid", r"don't\s+want",
    r"we\s+are\s+not", r"should\s+not",
)

PHILOSOPHY_PATTERNS = {
    "product_mindset": (r"product", r"user[\s-]?facing", r"ship(?:ping)?", r"launch",
                        r"impact", r"customer", r"real[\s-]?world"),
    "production_experience": (r"production", r"deploy", r"scale", r"infrastructure",
                              r"reliability", r"monitor", r"ops"),
    "startup_adaptability": (r"startup", r"fast[\s-]?paced", r"agile", r"scrappy",
                             r"ownership", r"wear\s+many\s+hats", r"ambiguity"),
    "research_orientation": (r"research", r"paper", r"novel",
                             r"state[\s-]?of[\s-]?the[\s-]?art",
                             r"experiment", r"hypothesis"),
    "execution_speed": (r"fast", r"rapid", r"quick", r"velocity",
                        r"iterate", r"move\s+fast", r"deadline"),
}

CONCEPT_CLUSTERS = {
    "Retrieval Engineering": ("retrieval", "search", "vector", "embedding", "ranking",
                              "semantic search", "information retrieval", "FAISS", "Pinecone"),
    "LLM Engineering": ("LLM", "language model", "transformer", "GPT", "fine-tuning",
                        "prompt engineering", "RAG", "LangChain"),
    "Production ML": ("production", "deployment", "MLOps", "monitoring",
                      "evaluation", "A/B testing", "infrastructure"),
    "Data Engineering": ("data pipeline", "ETL", "Spark", "Kafka", "Airflow",
                         "data warehouse", "streaming"),
    "Software Engineering": ("Python", "API", "microservices", "Docker", "Kubernetes",
                             "CI/CD", "testing", "code quality"),
}

BEHAVIOR_TERMS = {
    "collaboration": ("collaborat", "team", "cross-functional"),
    "communication": ("communicat", "present", "articulate"),
    "ownership": ("ownership", "autonomous", "self-driven", "initiative"),
    "learning": ("learn", "curios", "growth mindset"),
    "problem_solving": ("problem solving", "analytical", "critical thinking"),
}

# Years of experience asked for; the first pattern that occurs decides (order matters).
YEARS_PATTERNS = (
    r"(\d+)\s*[-–]\s*(\d+)\s*years?",
    r"(\d+)\+\s*years?",
    r"at\s+least\s+(\d+)\s*years?",
    r"minimum\s+(\d+)\s*years?",
)
YEARS_CONSTRAINT_PATTERN = r"(\d+)\+?\s*(?:to\s+(\d+))?\s*years?"
WORK_MODE_TERMS = ("remote", "hybrid", "onsite", "on-site", "in-office")
BULLET_MARKS = ("•", "-", "–", "→", "*", "►")
DEFAULT_SECTION = "Introduction"
MAX_YEARS = 50.0

# Score dimensions: key, label in reports, base weight.
DIMENSIONS = (
    ("technical_alignment", "Technical Alignment", 0.25),
    ("semantic_relevance", "Semantic Relevance", 0.20),
    ("evidence_strength", "Evidence Strength", 0.20),
    ("authenticity", "Profile Authenticity", 0.10),
    ("career_narrative", "Career Narrative", 0.10),
    ("behavioral", "Behavioral Intelligence", 0.08),
    ("recruitability", "Recruitability", 0.07),
)

AUTHENTICITY_WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.05, 0.10)
NARRATIVE_WEIGHTS = (0.30, 0.25, 0.25, 0.20)
BEHAVIOR_WEIGHTS = (0.15, 0.20, 0.10, 0.15, 0.10, 0.15, 0.15)
RECRUITABILITY_WEIGHTS = (0.30, 0.25, 0.25, 0.20)

# Cut-offs of the staged funnel: cheap, semantic, evidence, behaviour, final.
FUNNEL_CUTOFFS = (15000, 3000, 1000, 500, 100)
DEFAULT_TOP_K = 100
