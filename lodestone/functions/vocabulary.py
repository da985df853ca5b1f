"""Controlled vocabularies and defaults."""

# Fixed values.
TAGS = ("all", "finance", "hr", "legal", "engineering", "product", "management")
LEVELS = {"public": 0, "internal": 1, "confidential": 2}
DEFAULT_ORDINAL = 1
ROLES = ("user", "assistant")
CONVERTIBLE = ("doc", "docx", "ppt", "pptx", "xls", "xlsx", "odt", "odp", "ods", "rtf")
DIRECT = ("pdf", "md", "txt")
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
TOP_K, RERANK_K, RRF_K, RERANK_THRESHOLD = 20, 5, 60, 0.001
TRIGRAM_THRESHOLD = 0.3
HISTORY_TURNS, HISTORY_TOKENS = 5, 1500
MEMORY_K, MEMORY_SIMILARITY, MEMORY_CAP, MEMORY_LEAST = 5, 0.88, 50, 15
CHUNK_TOKENS, CHUNK_OVERLAP, CHUNK_LEAST = 512, 50, 20
PHRASES_PER_USER, PHRASE_LENGTH, TITLE_LENGTH = 15, 200, 200
NO_CONTENT = "no_relevant_content"
