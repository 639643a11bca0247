"""Lists, patterns and rates that results depend on."""

# Stop words of the vector builder (Turkish, English).
VECTOR_STOPWORDS_TR = ["ve", "ile", "bir", "bu", "şu", "o", "da", "de", "ta", "te", "ya", "ye", "mi", "mu", "mı", "mü"]
VECTOR_STOPWORDS_EN = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could",
    "can", "cannot", "this", "that", "these", "those", "i", "you", "he", "she", "it", "we", "they", "my", "your",
    "his", "her", "its", "our", "their",
]
# Stop words of the keyword extractor.
KEYWORD_STOPWORDS = [
    "nasıl", "nedir", "hangi", "kaç", "ne", "ile", "ve", "veya", "ama", "fakat", "ancak", "çünkü", "eğer", "ise",
    "de", "da", "te", "ta", "mi", "mı", "mu", "mü",
]
# Letters kept besides ASCII word characters.
TURKISH_LETTERS = "çğıöşüÇĞIİÖŞÜ"

# Retrieval settings.
VECTOR_DIMS = 200
CHUNK_TOKENS = 750
CHUNK_OVERLAP = 100
TOP_K = 5
VECTOR_WEIGHT = 0.7
RANK_WEIGHT = 0.3
KEYWORD_WEIGHT = 0.5
LONG_TEXT_BONUS = 0.5
LONG_TEXT_CHARS = 200
DUPLICATE_THRESHOLD = 0.7
DUPLICATE_MIN_CHARS = 20

# Citation limits.
CITATIONS_PER_FILE = 5
CITATIONS_TOTAL = 30
CITATION_MIN_RELEVANCE = 0.45

# Billing.
DEFAULT_RATE = 6.0
CANCEL_RATE = 1.15

# Permission bits.
VIEW, EDIT, DELETE, SHARE = 1, 2, 4, 8

# Limits, intervals and thresholds of the request stream.
BAN_INTERVAL = 20
BAN_MINUTES = 120
CONCURRENT_LIMIT = 2
SYNC_THRESHOLD = 1000
SYNC_BATCH = 100

# Retention of temporary conversations in hours.
RETENTION_DEFAULT, RETENTION_MIN, RETENTION_MAX = 720, 1, 8760
