"""Word lists, tables and constants of the data model.

All of them are fixed values: results depend on each entry.
"""

# Full-text query: words that match almost every document.
SEARCH_STOP_WORDS = (
    "i me my we our you your he she it they them their a an the this that these those is am are was were be been do did "
    "does done have has had will would could should can may not no so if but and or in on at to for of with by from up out "
    "about into what when where who how which there here than then also just get got give gave make made go went come came "
    "take took some any all very much more ago last being"
).split()

# Keyword extraction.
KEYWORD_STOP_WORDS = (
    "what when where who how which did do was were have has had is are the a an my me i you your their it its in on at to "
    "for of with by from ago last that this there about get got give gave buy bought made make"
).split()

# Query router.
PREFERENCE_SIGNALS = [
    "suggest", "recommend", "should i", "what should", "any tips", "can you help me find", "complement", "what would go well",
    "serve for", "activities", "accessories", "publications", "conferences",
]
TEMPORAL_SIGNALS = [
    "ago", "last week", "last month", "months ago", "weeks ago", "days ago", "how many months", "how many days", "how long", "when did",
    "what did i do on", "recently",
]

# Conversation rooms by substring counts, in order of declaration.
CONVERSATION_ROOMS = {
    "architecture": ["architecture", "design pattern", "system design", "microservice"],
    "debugging": ["bug", "error", "fix", "crash", "exception", "stack trace"],
    "database": ["database", "sql", "postgres", "mysql", "migration", "schema"],
    "frontend": ["react", "vue", "css", "html", "component", "ui", "ux"],
    "backend": ["api", "endpoint", "server", "route", "middleware", "graphql"],
    "devops": ["deploy", "docker", "kubernetes", "ci/cd", "pipeline", "aws"],
}

# Path segments by room.
FOLDER_ROOMS = {
    "frontend": "frontend front-end front_end client ui views components pages",
    "backend": "backend back-end back_end server api routes services controllers models database db",
    "documentation": "docs doc documentation wiki readme notes",
    "design": "design designs mockups wireframes assets storyboard",
    "costs": "costs cost budget finance financial pricing invoices accounting",
    "meetings": "meetings meeting calls meeting_notes standup minutes",
    "team": "team staff hr hiring employees people",
    "research": "research references reading papers",
    "planning": "planning roadmap strategy specs requirements",
    "testing": "tests test testing qa",
    "scripts": "scripts tools utils",
    "configuration": "config configs settings infrastructure infra deploy",
}

# Memory types by marker.
MEMORY_MARKERS = {
    "decision": ["decided", "chose", "picked", "went with", "settled on"],
    "preference": ["always use", "never do", "prefer", "i like", "i hate", "favorite"],
    "milestone": ["shipped", "launched", "completed", "finished", "achieved", "deployed", "released"],
    "problem": ["bug", "error", "crash", "broken", "fix", "workaround", "root cause"],
    "emotional": ["frustrated", "excited", "worried", "happy", "stressed", "grateful", "anxious"],
}

# Entity detection. %s stands for the candidate name, \b for the edge of an ASCII word.
PERSON_VERBS = [
    r"\b%s\s+said\b", r"\b%s\s+asked\b", r"\b%s\s+told\b", r"\b%s\s+replied\b", r"\b%s\s+laughed\b", r"\b%s\s+smiled\b", r"\b%s\s+cried\b",
    r"\b%s\s+felt\b", r"\b%s\s+thinks?\b", r"\b%s\s+wants?\b", r"\b%s\s+loves?\b", r"\b%s\s+hates?\b", r"\b%s\s+knows?\b", r"\b%s\s+decided\b",
    r"\b%s\s+pushed\b", r"\b%s\s+wrote\b", r"\bhey\s+%s\b", r"\bthanks?\s+%s\b", r"\bhi\s+%s\b", r"\bdear\s+%s\b",
]
DIALOGUE = [r"(?m)^>\s*%s[:\s]", r"(?m)^%s:\s", r"(?m)^\[%s\]", r'"%s\s+said']
PROJECT_VERBS = [
    r"\bbuilding\s+%s\b", r"\bbuilt\s+%s\b", r"\bship(?:ping|ped)?\s+%s\b", r"\blaunch(?:ing|ed)?\s+%s\b", r"\bdeploy(?:ing|ed)?\s+%s\b",
    r"\binstall(?:ing|ed)?\s+%s\b", r"\bthe\s+%s\s+architecture\b", r"\bthe\s+%s\s+pipeline\b", r"\bthe\s+%s\s+system\b", r"\bthe\s+%s\s+repo\b",
    r"\b%s\s+v\d+\b", r"\b%s\.(?:py|js|ts|yaml|yml|json|sh)\b", r"\b%s-core\b", r"\b%s-local\b", r"\bimport\s+%s\b", r"\bpip\s+install\s+%s\b",
]
ADDRESSED = r"\bhey\s+%s\b|\bthanks?\s+%s\b|\bhi\s+%s\b"
VERSIONED = r"\b%s[-v]\w+"
CODE_REFERENCE = r"\b%s\.(?:py|js|ts|yaml|yml|json|sh)\b"
PRONOUNS = "she her hers he him his they them their".split()
ENTITY_STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might "
    "must shall can this that these those it its they them their we our you your my me he she his her who what when where why how which if then so not "
    "no yes ok okay just very really also already still even only here there now too up out about like use get got make made take put come go see know "
    "think true false none null new old all any some step usage run check find add set list note example every each more less next last first second "
    "test stop start copy move source target output input data item key value world well want topic memory model models system version"
).split()

# Symbolic compression.
DIALECT_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as "
    "into about between through during before after above below up down out off over under again further then once here there when where why how all "
    "each every both few more most other some such no nor not only own same so than too very just don now and but or if while that this these those it "
    "its i we you he she they me him her us them my your his our their what which who whom also much many like because since get got use used using "
    "make made thing things way well really want need"
).split()
DECISION_WORDS = (
    "decided because instead prefer switched chose realized important key critical discovered learned conclusion solution reason why breakthrough insight"
).split()
EMOTIONS = {
    "decided": "determ", "prefer": "convict", "worried": "anx", "excited": "excite", "frustrated": "frust", "confused": "confuse", "love": "love", "hate": "rage",
    "hope": "hope", "fear": "fear", "trust": "trust", "happy": "joy", "sad": "grief", "surprised": "surprise", "grateful": "grat", "curious": "curious",
    "wonder": "wonder", "anxious": "anx", "relieved": "relief", "satisf": "satis", "disappoint": "grief", "concern": "anx", "hopeless": "despair", "stuck": "frust",
    "desperate": "despair", "peaceful": "peace", "calm": "peace", "angry": "rage", "terrified": "fear", "joyful": "joy", "vulnerable": "vul", "exhausted": "exhaust",
    "determined": "determ", "passionate": "passion", "tender": "tender", "humor": "humor", "funny": "humor", "doubt": "doubt", "frustration": "frust",
    "anxiety": "anx", "excitement": "excite", "satisfaction": "satis", "disappointment": "grief",
}
FLAGS = {
    "decided": "DECISION", "chose": "DECISION", "picked": "DECISION", "selected": "DECISION", "went with": "DECISION", "settled on": "DECISION", "switched": "DECISION",
    "migrated": "DECISION", "replaced": "DECISION", "instead of": "DECISION", "because": "DECISION", "blocked": "BLOCKER", "stuck": "BLOCKER", "can't": "BLOCKER",
    "cannot": "BLOCKER", "impossible": "BLOCKER", "preventing": "BLOCKER", "shipped": "MILESTONE", "launched": "ORIGIN", "completed": "MILESTONE", "finished": "MILESTONE",
    "achieved": "MILESTONE", "deployed": "MILESTONE", "released": "MILESTONE", "wondering": "QUESTION", "unsure": "QUESTION", "should we": "QUESTION", "what if": "QUESTION",
    "how do we": "QUESTION", "risky": "RISK", "dangerous": "RISK", "concerned about": "RISK", "might fail": "RISK", "founded": "ORIGIN", "created": "ORIGIN",
    "started": "ORIGIN", "born": "ORIGIN", "first time": "ORIGIN", "core": "CORE", "fundamental": "CORE", "essential": "CORE", "principle": "CORE", "belief": "CORE",
    "turning point": "PIVOT", "changed everything": "PIVOT", "realized": "PIVOT", "breakthrough": "PIVOT", "epiphany": "PIVOT", "api": "TECHNICAL", "database": "TECHNICAL",
    "architecture": "TECHNICAL", "deploy": "TECHNICAL", "infrastructure": "TECHNICAL", "algorithm": "TECHNICAL", "framework": "TECHNICAL", "server": "TECHNICAL", "config": "TECHNICAL",
}

# Project walk: directories and file extensions that are skipped, configuration file names.
SKIPPED_DIRS = ".git node_modules __pycache__ .venv venv env dist build .next coverage".split()
BINARY_EXTENSIONS = ".png .jpg .jpeg .gif .ico .svg .woff .woff2 .ttf .eot .mp3 .mp4 .zip .tar .gz .exe .dll .so .dylib .pyc .o .a .pdf".split()

# Retrieval constants.
BM25_K1, BM25_B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, RRF_BM25_WEIGHT, RRF_VECTOR_WEIGHT = 60, 1.0, 1.5
ROUTER_WEIGHTS = {"TEMPORAL": (1.0, 1.5), "FACT": (1.5, 1.0)}
HYBRID_BOOST = 0.30
CHUNK_BYTES, CHUNK_OVERLAP = 800, 100
