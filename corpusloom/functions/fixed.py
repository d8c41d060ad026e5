"""Word lists, patterns, limits and enumerations that results depend on."""

from __future__ import annotations

# ---- fixed values: limits ----
MIN_TERM_LEN = 4
RARE_TERM_MAX_DF = 0.01
MAX_TF = 5
FUSION_POOL = 200
RRF_K = 60
TARGET_CHUNK_CHARS = 1200
MAX_CHUNK_CHARS = 2200
MIN_CHUNK_CHARS = 200
MIN_TITLE_CHARS = 3
MAX_TITLE_CHARS = 80
UPPERCASE_TITLE_RATIO = 0.8
GARBAGE_FLAG = 0.15
GARBAGE_DROP_CHUNK = 0.20
GARBAGE_DROP_BOOK = 0.25
GARBAGE_SAMPLE = 40_000
LANGUAGE_SAMPLE = 20_000
GARBAGE_MIN_RUN = 4
GARBAGE_MIN_WORDS = 20
REPEAT_THRESHOLD = 5
MIN_RAW_CHARS = 200
CANDIDATE_MIN_SHARE = 0.2
MAX_CANDIDATES = 3
SHINGLE_WORDS = 5
MIN_CONTAINMENT = 0.15
TOME_CHAR_FLOOR = 1_000_000
PAGE_MIN_LETTERS = 40
NO_TEXT_SHARE = 0.8
PARTIAL_TEXT_SHARE = 0.2
MAX_TURNS = 6
TTL_SECONDS = 1800
MAX_CONVERSATIONS = 500
MAX_ANSWER_CHARS = 1500
CONTEXT_CHARS = 60_000
WEB_CONTEXT_CHARS = 6_000
BATCH_ITEMS = 500
BATCH_TOKENS = 120_000
CHARS_PER_TOKEN = 3.5
REBUILD_COVERAGE = 0.9
MIN_FILE_BYTES = 200

# ---- fixed values: enumerations ----
KINDS = ("receita", "tecnica", "texto")
TIERS = ("receitas", "tecnica", "descartado")
REGIONS = (
    "brasileira", "francesa", "italiana", "portuguesa", "espanhola", "mexicana", "latino_americana", "japonesa", "chinesa",
    "outras_asiaticas", "indiana", "do_oriente_medio", "africana", "nordica", "mediterranea", "americana", "internacional", "nao_especificado",
)
STATUSES = ("queued", "processing", "added", "duplicate", "discarded", "no_text", "error", "cancelled")
STAGES = ("waiting_for_index_lock", "extracting", "ocr", "cleaning", "chunking", "embedding", "checking_duplicates", "metadata", "indexing")
UNCANCELLABLE_STAGES = ("indexing", "waiting_for_index_lock")
ACTIVE_STATUSES = ("queued", "processing")
PENDING_STATUSES = ("queued", "processing", "no_text")
OCR_MODES = ("none", "ocr", "skip_ocr")
RETRYABLE_REASONS = ("embeddings_unavailable", "interrupted", "internal")
TRANSITIONS = (
    ("new", "queued"), ("new", "duplicate"), ("queued", "processing"),
    ("processing", "added"), ("processing", "duplicate"), ("processing", "discarded"), ("processing", "no_text"), ("processing", "error"),
    ("no_text", "queued"), ("error", "queued"),
    ("queued", "cancelled"), ("processing", "cancelled"), ("no_text", "cancelled"),
)
FORMATS = ("pdf", "epub", "docx", "odt", "rtf", "html", "txt", "md")
FORMAT_ALIASES = {"htm": "html"}

# ---- fixed values: word lists ----
STOPWORDS = (
    "como para fazer receita receitas qual quais onde quando porque sobre isso esse essa este esta "
    "completa completo simples facil rapida rapido melhor melhores tipo tipos modo preparo usar "
    "what which when where does with from have that this make recipe recipes best easy simple "
    "comment faire recette recettes avec pour dans quelle quel cette como hacer receta recetas "
    "come fare ricetta ricette della sono"
).split()
LANGUAGE_WORDS = {
    "pt": "que|nao|com|para|uma|voce|entao|acucar|colher|xicara|farinha|receita",
    "en": "the|and|with|cup|tablespoon|flour|butter|until|recipe",
    "fr": "les|dans|avec|une|beurre|farine|cuillere|faites|recette",
    "es": "los|con|para|una|harina|cucharada|azucar|receta",
    "it": "gli|con|della|una|farina|cucchiaio|zucchero|ricetta",
}
REGION_KEYWORDS = {
    "francesa": ["frances", "française", "la cuisine", "paris", "escoffier", "bordeaux", "provence", "lyon"],
    "italiana": ["italian", "toscana", "roma", "sicilia", "pasta", "risotto", "parmigiano"],
    "portuguesa": ["portugu", "lisboa", "porto", "bacalhau", "algarve"],
    "espanhola": ["espanhol", "español", "tapas", "paella", "madrid"],
    "mexicana": ["mexican", "méxico", "taco", "tortilla", "mole "],
    "japonesa": ["japan", "japon", "sushi", "sashimi", "miso", "dashi"],
    "chinesa": ["chinese", "chines", "wok", "sichuan", "cantones"],
    "indiana": ["indian", "índia", "india", "curry", "masala", "tandoori"],
    "do_oriente_medio": ["oriente medio", "libanes", "turco", "marroquin", "hummus", "kebab", "tahine"],
    "africana": ["africana", "africano", "etiop", "magreb"],
    "nordica": ["nordic", "nordica", "escandinav", "noma", "redzepi", "dinamarqu", "sueco", "norueg"],
    "latino_americana": ["peruan", "argentin", "chilen", "colombian", "latino-americ", "latino americ"],
    "mediterranea": ["mediterran", "grega", "grego", "levante"],
    "americana": ["american", "usa", "texas", "bbq", "estados unidos"],
    "brasileira": ["brasil", "bahia", "baiana", "mineir", "nordestin", "feijão", "feijao", "farofa", "tapioca", "acaraje", "acarajé", "moqueca", "cachaça", "cachaca"],
}
DISH_KEYWORDS = {
    "sobremesa": ["sobremesa", "doce", "bolo", "torta doce", "pudim", "brigadeiro", "cookie", "mousse", "sorvete"],
    "panificacao": ["pão", "pao ", "padaria", "fermenta", "focaccia", "brioche", "baguete", "pizza"],
    "confeitaria": ["confeitaria", "macaron", "petit gateau", "bombom", "trufa", "chocolate"],
    "bebida": ["drink", "coquetel", "cocktail", "suco", "vinho", "cerveja", "destilado", "licor"],
    "molho_e_conserva": ["molho", "sauce", "conserva", "geleia", "picles", "vinagrete"],
    "salgado_e_lanche": ["salgado", "lanche", "sanduiche", "sanduíche", "petisco", "aperitivo"],
    "sopa_e_caldo": ["sopa", "caldo", "creme de", "canja"],
    "acompanhamento": ["acompanhamento", "guarniç", "purê", "pure de"],
    "tecnica_e_fundamento": ["tecnica", "técnica", "fundamentos", "fermentação", "sous vide", "defumação", "molecular"],
    "historia_e_cultura": ["historia", "história", "cultura", "tradição", "origem do", "antropologia"],
}

# ---- fixed values: patterns (those of lines are for one line at a time) ----
SEPARATOR_ROW = r"^\s*\|?[\s|:\-]{3,}\|?\s*$"
PAGE_NUMBER = r"^\s*[\-–—]?\s*\d{1,4}\s*[\-–—]?\s*$"
ROMAN_NUMBER = r"^\s*[ivxlcdmIVXLCDM]{1,7}\s*$"
DOT_LEADER = r"^[.\s]{10,}$"
DIGIT_RUN = r"^\s*[\d\s.\-–—/]{6,}\s*$"
URL_ONLY = r"(?i)^\s*(https?://|www\.)\S+\s*$"
ISBN_LINE = r"(?i)^\s*ISBN\b"
TABLE_ROW = r"^\s*\|.*\|\s*$|^\s*[^|\n]*\|[^|\n]*\|"
SPAM_LINE = (
    r"(?i)(direitos\s+reservados|todos\s+os\s+direitos|copyright\s*©|instagram\s*:?\s*@|@[a-z0-9_.]+(receitas|cook|chef|food)|"
    r"siga.{0,20}(instagram|facebook)|compartilhe\s+esta\s+receita|baixe\s+(o\s+)?e-?book|clique\s+aqui|acesse\s+o\s+link)"
)
SCAFFOLD_LINE = (
    r"(?im)^\s*[\*\-#>\s]*(ingredientes?|modo\s+de\s+(preparo|fazer)|preparo|preparaç[ãa]o|rendimento|rende|porç[õo]es|tempo\s+de\s+preparo|"
    r"dica[s]?|observaç[õo]es?|ingredients?|instructions?|directions?|method|preparation|yield|serves?|ingr[ée]dients?|pr[ée]paration|"
    r"ingredienti|preparazione|ingredientes|preparaci[óo]n|proportions?|proc[ée]d[ée])\s*[:\-–]?\s*[\*\s]*$"
)
SENTENCE_END = r"[.!?:;)\"”’»]\s*$"
LIST_START = r"^\s*([\-*•▪◦]|\d{1,2}[.)]|\(\d{1,2}\))\s+\S"
TITLE_LINE = r"^[A-ZÀ-Ü0-9][A-ZÀ-Ü0-9\s'’«»\-,.&()/ºª%]{2,72}$"
TITLE_CASE = r"^([A-ZÀ-Ü][a-zà-ÿ'’]*\s*){2,10}$"
INGREDIENT_HEADER = r"(?im)^\s*[*\-#>\s]*(ingredientes?|ingredients?|ingr[ée]dients?|ingredienti)\s*[:\-–]?\s*[*\s]*$"
METHOD_HEADER = (
    r"(?im)^\s*[*\-#>\s]*(modo\s+de\s+(preparo|fazer)|preparo|preparaç[ãa]o|preparation|method|directions?|instructions?|pr[ée]paration|"
    r"preparazione|procedimento|preparaci[óo]n)\s*[:\-–]?\s*[*\s]*$"
)
CLASSIC_HEADER = r"(?im)^\s*(proportions?|proc[ée]d[ée])\s*[:.]"
QUANTITY_LINE = (
    r"(?im)^\s*[\*\-•]?\s*\d+[\d/,.\s]*\s*(x[ií]caras?|colheres?\s+de|c\.?\s?s\.?|c\.?\s?ch\.?|gramas?|g\b|kg|ml|l\b|litros?|cups?|tbsp|tsp|"
    r"tablespoons?|teaspoons?|ounces?|oz\b|lb\b|pounds?|cucchia\w+|cuiller\w+|taza|cucharad\w+|unidades?|dentes?\s+de|latas?|pitadas?)\b"
)
YIELD_LINE = r"(?im)^\s*(rendimento|rende|porç[õo]es|serves?|yield|makes|pour\s+\d+\s+personnes?|per\s+\d+\s+persone|rinde)\b"
CULINARY_WORD = (
    r"(?i)\b(receita|recipe|recette|ricetta|cozinh\w*|cook\w*|culin[aá]r\w*|chef|forno|oven|fritar|assar|refogar|saut[eé]|massa|dough|molho|"
    r"sauce|tempero|season\w*|panela|skillet)\b"
)
NON_CULINARY = (
    r"(?i)\b(administraç[ãa]o de marketing|teoria geral da administraç|kotler|chiavenato|segmentaç[ãa]o de mercado|vantagem competitiva|"
    r"demonstraç[õo]es financeiras|fluxo de caixa|balanced scorecard|spectrophotomet\w*|chromatograph\w*|titration|standard deviation|"
    r"regression analysis|p\s*<\s*0[.,]05|hplc|sds-page|plano de neg[oó]cios|gest[ãa]o financeira|precificaç[ãa]o)\b"
)
CITATION = r"\s?\[\d+\]"

# Layout of a page's lines; what a source shows of a book.
PARAGRAPH_PITCH = 1.4
SHOWN_DISH_TYPES = 2
SHOWN_INGREDIENTS = 15
