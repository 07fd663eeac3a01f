"""Word lists, maps and constants. All of these are fixed values: results depend on each of them."""

QUESTION_WORDS = ("how", "what", "when", "where", "which", "who", "whom", "whose", "why")
STOP_WORDS = ("a", "an", "and", "are", "at", "be", "by", "did", "do", "does", "for", "i", "in", "is", "it", "its", "me", "my", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
STRUCTURAL_PREDICATES = ("has_heading", "has_tag", "links_to")
STRUCTURAL_TITLE_STARTS = ("heading:", "tag:", "wikilink:")
METADATA_PREDICATES = (
    "built_date", "byte_size", "checksum", "created_date", "creation_date", "file_extension", "file_name", "file_path", "file_size", "file_type", "filename", "filepath", "filesize", "filetype",
    "is_version", "kind_of", "label", "labels", "last_modified", "md5", "mime_type", "mimetype", "modified_date", "sha256", "source", "tag", "tags", "version",
)
NOISY_PREDICATES = ("n_a", "na", "none", "null", "unknown")
GENERIC_TITLES = ("doc", "file", "image", "link", "pdf", "url")
GENERIC_TOKENS = ("and", "dept", "group", "inc", "llc", "ltd", "of", "team", "the")
COMPANY_SUFFIXES = ("books", "co", "company", "corp", "corporation", "inc", "incorporated", "limited", "llc", "ltd", "plc", "press", "publisher", "publishers", "publishing")
PRIMITIVE_TYPES = ("Activity", "Agent", "Concept", "InformationObject", "Place")
SUPPORT_TYPES = ("Annotation", "Block", "Claim", "Document", "Finding", "Identifier")
VETO_PREDICATES = ("different_from", "distinguished_from", "not_same_as")
PLACEHOLDER_PREDICATES = ("", "n/a", "na", "none", "null", "undefined", "unknown")
PLACEHOLDER_LABELS = ("n_a", "na", "none", "null", "undefined", "unknown")
GRAMMATICAL_GLUE = ("and", "by", "from", "is", "of", "or", "the", "to", "was", "were", "with")
DENIED_PREDICATES = (*PLACEHOLDER_LABELS, *GRAMMATICAL_GLUE)
CLAIM_REFERENCES = ("O_id", "S_id", "agent_id", "block_id", "extraction_activity_id")
CLOSURE_KEYS = ("closed_for", "closes", "closure", "closure_for", "evidence", "evidence_for", "resolved_for", "resolves", "resolves_commitment")
CORE_PREDICATES = (
    "author_of", "authored_by", "compiled_by", "compiler_of", "constrains", "contrasts_with", "contributor_to", "defines", "describes", "edited_by", "editor_of", "example", "has_value",
    "includes", "progresses_to", "recommended_approach", "requires", "uses", "wrote_to",
)
PREDICATE_ALIASES = {
    "advances_to": "progresses_to", "analogy": "example", "assisted_by": "contributor_to", "authored": "author_of", "characteristic": "describes", "characterized_by": "describes",
    "compiled": "compiler_of", "constraint": "constrains", "contrasted_with": "contrasts_with", "contrasts": "contrasts_with", "contributed_to": "contributor_to", "defined_as": "defines",
    "defines_rule": "defines", "defines_score": "defines", "described_as": "describes", "describes_as": "describes", "edited": "editor_of", "followed_by": "progresses_to",
    "has_condition": "requires", "has_criterion": "requires", "has_phase": "includes", "includes_competency": "includes", "includes_mechanism": "includes", "includes_phase": "includes",
    "includes_principle": "includes", "includes_stage": "includes", "includes_strategy": "includes", "is_analogy": "example", "is_constraint": "constrains", "is_defined_as": "defines",
    "is_described_as": "describes", "letter_to": "wrote_to", "next_level": "progresses_to", "rates": "describes", "recommendation": "recommended_approach",
    "recommended_view": "recommended_approach", "requires_competency": "requires", "sent_letter_to": "wrote_to", "sent_to": "wrote_to", "uses_analogy": "example", "uses_framework": "uses",
    "uses_methodology": "uses", "uses_mindset": "uses", "uses_tool": "uses", "uses_workflow": "uses", "with_assistance_of": "contributor_to", "written": "author_of",
    "written_by": "authored_by", "wrote_letter_to": "wrote_to",
}
FILE_ENDINGS = "md|markdown|txt|pdf|csv|tsv|json|ya?ml|toml|ini|cfg|lock|log|xml|html?|py|js|ts|tsx|jsx|sh|bash|zsh|sql|db|sqlite3?|png|jpe?g|gif|svg|zip|gz|xlsx?|docx?|pptx?"

BM25_K1, BM25_B = 1.5, 0.75
RRF_K = 60
EXPANSION_SEEDS, HOP_DISCOUNT = 10, 0.5
LEAST_RESULTS = 20
SEED_SUBJECT_CAP, SEED_ENTITY_MIN, SEED_RELATION_MIN, SEED_SCALAR_MAX = 3, 6, 4, 10
METADATA_WEIGHT, LOW_VALUE_WEIGHT = 0.15, 0.3
CLAIM_CONFIDENCE = 0.7
SIMILAR_COSINE = 0.82
RECALL_FLOOR, STRONG_JARO_WINKLER, FUZZY_MIN_LENGTH, CLASS_CAP = 0.65, 0.90, 7, 8
TOKEN_FACTOR = 1.117
CHUNK_BYTES, LEGACY_CHUNK_BYTES = 6_000, 12_000
QUIET_SECONDS, FLOOR_SECONDS = 3, 10
REFERENCE_DATE = "2026-05-19"
