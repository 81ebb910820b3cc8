"""Word lists, lookup tables, patterns and texts that results depend on.

Every operator takes these as defaults of a parameter, so another corpus can bring its own.
"""

# --- characters -----------------------------------------------------------------------------
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
WESTERN_DIGITS = "0123456789"
ALEF_FORMS = "إأآٱ"
TATWEEL = "ـ"
DIACRITICS = "".join(chr(c) for c in range(0x064B, 0x0660)) + "ٰ"

# Regex classes valid in both Java and RE2 that agree with Python's Unicode \s and \w.
WS = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
WORD = r"\p{L}\p{N}_"

# --- corpus facts ---------------------------------------------------------------------------
MAX_ARTICLE = 1149
REPEALED_RANGES = [(54, 80), (389, 417)]
CITATION_PREFIX = "Egyptian Civil Code, Article "
MAX_TEXT_CHARS = 5000
HEADER_STEP = 5
HEADER_LONG_STEP = 35
HEADER_LONG_STEP_AFTER = [53, 54, 388]
DEFAULT_HEADINGS = {
    "book": "General Provisions (باب تمهيدي)",
    "part": "General Provisions",
    "chapter": "General Provisions",
    "section": "Law and its Application",
    "topic": "",
}

# --- patterns -------------------------------------------------------------------------------
FURNITURE_PATTERN = rf"^[{WS}]*-[{WS}]*[0-9]+[{WS}]*-[{WS}]*\z|^[{WS}]*(?i:ITI)(?:[^{WORD}]|\z)"
ARABIC_MARKER_PATTERN = rf"م[{WS}]*ا[{WS}]*د[{WS}]*ة"
HEADING_PATTERNS = [
    ("book", rf"(?i)^BOOK[{WS}]+[IVXLCDM]+"),
    ("part", rf"(?i)^(?:FIRST|SECOND|THIRD|FOURTH)[{WS}]+PART"),
    ("chapter", rf"(?i)^CHAPTER[{WS}]+[IVXLCDM]+"),
    ("section", rf"(?i)^SECTION[{WS}]+[IVXLCDM]+"),
    ("topic", rf"^[0-9]+\.[{WS}]+[A-Za-z]"),
]
REFERENCE_AR_PATTERN = (
    rf"(?:الماد[ةه]|ماد[ةه]|المادتين|المادتان|المواد|م[{WS}]*/?)[{WS}]*(?:رقم[{WS}]*)?(?:من[{WS}]*)?([0-9]+)"
    rf"(?:[{WS}]*(?:و|أو|او|إلى|الي|حتى|حتي|-)[{WS}]*([0-9]+))?"
)
REFERENCE_AR_STRICT_PATTERN = REFERENCE_AR_PATTERN.replace("(?:الماد", rf"(?:^|[^{WORD}])[وفبلك]*(?:الماد", 1)
REFERENCE_EN_PATTERN = rf"(?i)Articles?[{WS}]+[0-9]+(?:[{WS}]+and[{WS}]+[0-9]+)?"
CITED_BRACKET_PATTERN = rf"(?i)\[(?:المادة|Article)[{WS}]*([0-9]+)\]"

# --- retrieval ------------------------------------------------------------------------------
STOPWORDS = [
    "ما", "هي", "هو", "في", "من", "على", "عن", "الى", "إلى", "مع", "هذا", "هذه", "ذلك", "تلك",
    "التي", "الذي", "الذين", "اللاتي", "ان", "أن", "اذا", "إذا", "كان", "كانت", "يكون", "تكون",
    "او", "أو", "ثم", "حيث", "كل", "غير", "قد", "لا", "لم", "لن", "بين", "فان", "فإذا", "حتى",
    "كما", "بعد", "قبل",
]
SYNONYMS = [
    ("الرضا", "التراضي الاراده ارادتين الاهليه اهليه عيوب الرضا الغلط التدليس الاكراه الاستغلال"),
    ("رضا", "التراضي الاراده ارادتين الاهليه اهليه عيوب الرضا الغلط التدليس الاكراه الاستغلال"),
    ("التراضي", "الرضا الاراده ارادتين الاهليه عيوب الرضا الغلط التدليس الاكراه"),
    ("المسؤولية", "العمل غير المشروع التعويض الضرر الخطا علاقه السببيه"),
    ("التعويض", "الضرر الخطا المسؤوليه التقصيريه العمل غير المشروع"),
    ("الفسخ", "انحلال العقد عدم التنفيذ الاعذار"),
    ("البطلان", "ابطال العقد قابل للابطال المحل السبب الاهليه"),
    ("التقادم", "التقادم المسقط انقطاع التقادم وقف التقادم مده التقادم"),
    ("القوة القاهرة", "الحادث الفجائي استحاله التنفيذ الظروف الطارئه"),
]
REPEALED_KEYWORDS = ["ملغاة", "ملغاه", "الغيت", "ألغيت", "repealed", "repeal", "annulled"]
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, DENSE_WEIGHT, BM25_WEIGHT = 60, 0.7, 0.3

# --- small talk -----------------------------------------------------------------------------
GREETINGS = [
    "ازيك", "عامل ايه", "صباح الخير", "مساء الخير", "مرحبا", "أهلا", "اهلا", "السلام عليكم",
    "سلام", "سلام عليكم", "هاي", "hello", "hi", "hey",
]
THANKS = ["شكرا", "شكرًا", "تسلم", "جزاك الله", "مشكور", "شكرا جزيلا", "thanks", "thank you"]
IDENTITY = ["مين انت", "من انت", "من أنت", "عن النظام", "who are you"]

# --- answers --------------------------------------------------------------------------------
REFUSAL_AR = "لم أجد أساساً في القانون المدني للإجابة عن هذا السؤال."
REFUSAL_EN = "I could not find a basis in the Egyptian Civil Code to answer this question."
SYSTEM_PROMPT = (
    "Answer only from the articles given as context and cite each one as [المادة N] in Arabic or [Article N] "
    "in English. Reply in the language of the question and say when an article is repealed. When the context "
    f"holds no basis for an answer, reply exactly: {REFUSAL_AR} / {REFUSAL_EN}"
)
REFUSAL_MARK_AR = "لم أجد أساساً في القانون المدني"
REFUSAL_MARK_EN = "could not find a basis in the egyptian civil code"
EMPTY_CONTEXT = "لا تتوفر مواد قانونية مسترجعة (No articles retrieved)."
REPEALED_MARK = " (ملغاة - REPEALED)"
SINGLE_AR = ("وفقاً لأحكام [المادة ", "] من القانون المدني المصري:\n\n")
SINGLE_EN = ("According to [Article ", "] of the Egyptian Civil Code:\n\n")
MULTI_AR = "وفقاً لأحكام القانون المدني المصري المسترجعة ذات الصلة:"
MULTI_EN = "According to the relevant provisions of the Egyptian Civil Code:"
USER_PROMPT_AR = (
    "النصوص القانونية المسترجعة من القانون المدني المصري:\n",
    "\n\n---\nسؤال المستخدم:\n",
    "\n\nيرجى الإجابة بناءً على النصوص القانونية المرفقة أعلاه حصراً، وتوثيق الإجابة بأرقام المواد "
    "[المادة N]. إذا لم تكن الإجابة موجودة في النصوص، التزم بعبارة الرفض المحددة.",
)
USER_PROMPT_EN = (
    "Retrieved Articles from the Egyptian Civil Code:\n",
    "\n\n---\nUser Question:\n",
    "\n\nPlease answer solely based on the retrieved articles above, citing article numbers [Article N]. "
    "If the answer is not present in the text, provide the exact refusal statement.",
)

# --- status overlay notes -------------------------------------------------------------------
NOTE_54_AR = (
    "ألغيت المواد من 54 إلى 80 بالقرار الجمهوري بالقانون رقم 384 لسنة 1956 "
    "(الوقائع المصرية عدد 88 مكرر (ج) في 3/11/1956) ثم ألغي القانون بالقرار الجمهوري "
    "رقم 32 لسنة 1964 (الجريدة الرسمية عدد 37 في 12/3/1964)."
)
NOTE_54_EN = (
    "Articles 54-80 have been repealed by Presidential Decree Law No. 384 of 1956 "
    "and Presidential Decree No. 32 of 1964."
)
NOTE_389_AR = (
    "ألغيت المواد من 389 إلى 417 بموجب قانون الإثبات في المواد المدنية والتجارية "
    "رقم 25 لسنة 1968 (الجريدة الرسمية عدد 22 في 30/5/1968)."
)
NOTE_389_EN = (
    "Articles 389-417 have been repealed by the Law of Evidence in Civil and Commercial "
    "Matters (Law No. 25 of 1968)."
)
# lo, hi, page the hierarchy is taken from, overrides (None = take from the page), fallbacks, notes
OVERLAY_RANGES = [
    dict(lo=54, hi=80, page=7, chapter=None, section=None,
         fallback=("General Provisions", "Juristic Persons", "Classification of Things", "Associations"),
         note_ar=NOTE_54_AR, note_en=NOTE_54_EN),
    dict(lo=389, hi=417, page=53, chapter="Proof of Obligations (الباب السادس: إثبات الالتزام)",
         section="Proof (Repealed)",
         fallback=("Obligations Generally", "Obligations or Personal Rights", "", ""),
         note_ar=NOTE_389_AR, note_en=NOTE_389_EN),
]
OVERLAY_TOPIC = "Repealed Articles"

# --- evaluation and monitoring --------------------------------------------------------------
REQUIRED_CATEGORIES = ["contracts", "torts", "obligations", "property", "leases", "repealed", "out_of_scope"]
OFFLINE_FAITHFULNESS, OFFLINE_RELEVANCY = 0.95, 0.90
GATE_THRESHOLD, ALERT_THRESHOLD, MAX_ERROR_SHARE = 0.75, 0.80, 0.20
LATENCY_BUCKETS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
SCORE_BUCKETS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
DRIFT_THRESHOLD, DRIFT_P, DRIFT_MEAN = 0.45, 0.01, 0.40
DRIFT_VERDICT = "Query distribution significantly drifted from corpus centroid. Re-indexing or query routing recommended."
NO_DRIFT_VERDICT = "Query distribution is well-aligned with the statutory corpus centroid."
ROLLBACK_ERROR_RATE, ROLLBACK_P95_MS = 0.005, 2000.0
