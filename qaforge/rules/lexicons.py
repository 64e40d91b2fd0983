"""Word lists and label tables. Order matters everywhere: ties go to the entry listed first."""

# Words that mark a help page's address.
HELP_URL_WORDS = [
    "faq", "faqs", "help", "support", "customer-service",
    "knowledge", "knowledgebase", "kb", "guide",
    "how-to", "howto", "troubleshoot", "troubleshooting",
    "qna", "q&a", "questions", "getting-started", "contact-us",
]

# Words used to pick addresses from a sitemap, and to pre-test a page before parsing it.
SITEMAP_WORDS = ["faq", "faqs", "question", "qa", "help", "support", "product"]
PAGE_WORDS = ["faq", "question", "help", "support", "q:"]

# Address parts of static files and trackers (anywhere), and the suffix-only list.
ASSET_PATTERN = r"(\.pdf|\.jpg|\.png|\.gif|\.zip|\.mp4|\.css|\.js|\?.*utm|tracking)"
ASSET_SUFFIXES = [".pdf", ".jpg", ".png", ".gif", ".svg", ".zip", ".rar", ".7z", ".mp4", ".mp3", ".css", ".js"]

# Question words of the in-sentence test and of the start-of-text test.
QUESTION_WORDS = [
    "what", "how", "when", "where", "why", "which", "who", "do", "does", "did",
    "can", "should", "is", "are", "will", "there", "any",
]
QUESTION_STARTS = [
    "what", "how", "why", "when", "where", "which", "who", "can", "could", "should", "may",
    "is", "are", "will", "there", "any", "do", "does", "did", "have", "has", "had",
    r"i\s+am", r"am\s+i",
]

# Six-way intent.
INTENT6 = {
    "exploration": [
        "what", "tell me", "show me", "list", "options", "available", "latest", "new", "discover", "explore",
        "find", "browse", "recommend", "suggest", "demo", "sample", "preview", "tour", "overview",
    ],
    "information": [
        "how", "explain", "details", "information", "why", "when", "where", "compare", "define", "clarify",
        "describe", "meaning", "purpose", "background", "history", "process", "steps", "instruction", "guide",
        "manual", "policy", "procedure", "specification", "requirement",
    ],
    "conversion": [
        "buy", "purchase", "order", "book", "reserve", "subscribe", "sign up", "register", "enroll", "apply",
        "get", "acquire", "start", "begin", "activate", "upgrade", "download", "checkout", "add to cart", "pay",
        "payment", "confirm", "complete", "finish", "submit",
    ],
    "support": [
        "help", "issue", "problem", "error", "not working", "broken", "fix", "troubleshoot", "support", "assist",
        "resolve", "repair", "contact", "complaint", "refund", "cancel", "return", "replace", "lost", "forgot",
        "reset", "recover", "technical", "bug", "fail", "failure", "crash", "hang", "freeze",
    ],
    "feedback": [
        "feedback", "suggestion", "review", "rate", "opinion", "comment", "improve", "change", "update", "report",
        "complain", "recommend", "advise", "critic", "testimonial", "experience", "share", "survey", "poll",
    ],
    "followup": [
        "next", "follow up", "continue", "more", "additional", "further", "after", "then", "what's next", "step",
        "progress", "status", "update", "track", "monitor", "pending", "waiting", "queue",
    ],
}

# Four-way intent.
INTENT4 = {
    "exploration": ["what", "tell me", "show me", "list", "options", "available", "latest", "new"],
    "information": ["how", "explain", "details", "information", "why", "when", "where", "compare"],
    "conversion": ["buy", "purchase", "order", "book", "reserve", "subscribe", "sign up"],
    "support": ["help", "issue", "problem", "error", "not working", "broken", "fix", "troubleshoot"],
}

# Five-way domain.
DOMAIN5 = {
    "technical": ["api", "code", "developer", "implementation", "integration", "technical", "system"],
    "sales": ["price", "pricing", "cost", "discount", "offer", "package", "plan", "buy"],
    "booking": ["book", "schedule", "appointment", "reservation", "availability", "date", "time"],
    "support": ["help", "issue", "problem", "error", "support", "customer service", "assistance"],
    "product": ["product", "feature", "functionality", "capability", "benefit", "advantage"],
}

# Eight industries.
INDUSTRY8 = {
    "hospitality": [
        "hotel", "restaurant", "booking", "reservation", "guest", "stay",
        "check-in", "checkout", "amenity", "concierge", "lodge", "motel",
    ],
    "retail": [
        "store", "shop", "product", "inventory", "purchase", "item",
        "catalog", "discount", "offer", "sale", "checkout", "cart",
    ],
    "gaming": [
        "game", "play", "level", "score", "character", "achievement",
        "quest", "mission", "player", "multiplayer", "console", "app",
    ],
    "finance": [
        "bank", "account", "transaction", "investment", "loan", "credit",
        "deposit", "withdraw", "balance", "payment", "interest", "portfolio",
    ],
    "healthcare": [
        "doctor", "patient", "appointment", "prescription", "medical", "hospital",
        "clinic", "symptom", "treatment", "medicine", "health", "diagnosis",
    ],
    "education": [
        "student", "course", "class", "lesson", "university", "college",
        "school", "professor", "assignment", "exam", "learning", "enrollment",
    ],
    "technology": [
        "code", "api", "software", "system", "database", "server",
        "deployment", "integration", "developer", "framework", "library", "bug",
    ],
    "corporate": [
        "business", "company", "employee", "hr", "management", "meeting",
        "project", "deadline", "budget", "revenue", "strategy", "report",
    ],
}
INDUSTRY_INFO = {
    "hospitality": ("welcoming", "Hospitality & Tourism"),
    "retail": ("helpful", "Retail & E-Commerce"),
    "gaming": ("quirky", "Gaming & Entertainment"),
    "finance": ("professional", "Finance & Banking"),
    "healthcare": ("empathetic", "Healthcare & Medical"),
    "education": ("encouraging", "Education & Learning"),
    "technology": ("technical", "Technology & IT"),
    "corporate": ("professional", "Corporate Business"),
}

# Platforms (tone, description, style) and touchpoints (intent, description).
PLATFORMS = {
    "instagram": ("casual", "Instagram/Social Media", "friendly, engaging, emoji-friendly"),
    "corporate_website": ("professional", "Corporate Website", "formal, authoritative, structured"),
    "gaming_app": ("quirky", "Gaming/Entertainment App", "fun, playful, energetic"),
    "college_website": ("formal", "College/University", "academic, encouraging, informative"),
    "support_chat": ("empathetic", "Customer Support Chat", "helpful, patient, solution-focused"),
    "ecommerce": ("friendly", "E-Commerce Platform", "persuasive, helpful, product-focused"),
    "healthcare_portal": ("empathetic", "Healthcare Portal", "caring, clear, informative"),
    "technical_docs": ("technical", "Technical Documentation", "precise, detailed, example-based"),
}
PLATFORM_DEFAULT = ("neutral", "Unknown Platform", "helpful")
TOUCHPOINTS = {
    "home_page": ("exploration", "User exploring options and learning about offerings"),
    "product_page": ("information", "User wants detailed information about specific product/service"),
    "support_page": ("support", "User seeking issue resolution or help"),
    "checkout": ("conversion", "User ready to make purchase or commit to action"),
    "faq_section": ("information", "User looking for quick answers to common questions"),
    "feedback_form": ("support", "User providing feedback or reporting issues"),
}
TOUCHPOINT_DEFAULT = ("information", "Unknown Touchpoint")

# First-match rules for a prompt's likely platform and touchpoint.
PLATFORM_GUESS = {
    "ecommerce": ["buy", "cart", "discount", "sale", "checkout"],
    "support_chat": ["error", "issue", "help", "support", "not working", "fix"],
    "technical_docs": ["api", "docs", "developer", "example", "snippet"],
    "instagram": ["instagram", "social", "reel", "story"],
}
TOUCHPOINT_GUESS = {
    "product_page": ["price", "pricing", "feature", "compare", "details"],
    "checkout": ["book", "order", "subscribe", "checkout", "reserve"],
    "faq_section": ["faq", "how to", "steps", "guide"],
    "feedback_form": ["feedback", "complaint", "suggest", "improve"],
    "home_page": ["what", "options", "browse", "show", "tell"],
    "support_page": ["error", "issue", "help", "support", "not working", "fix"],
}

# Page contexts and their system messages.
CONTEXTS = {
    "support": ["help", "support", "faq", "customer-service"],
    "technical": ["api", "developer", "docs", "technical", "implementation"],
    "sales": ["pricing", "purchase", "product", "order", "buy"],
    "booking": ["schedule", "appointment", "booking", "reservation"],
}
CONTEXT_MESSAGES = {
    "support": "You are a customer support assistant. Provide clear and helpful answers to customer questions.",
    "technical": "You are a technical expert. Provide detailed and accurate technical information.",
    "sales": "You are a sales assistant. Help customers understand products and make informed decisions.",
    "booking": "You are a booking assistant. Help users schedule and manage their appointments efficiently.",
    "general": "You are a helpful assistant providing accurate information.",
}

# Topics, in map order, with their tones.
TOPIC_TONES = {
    "art": "creative", "automotive": "technical", "career": "motivational", "climate_change": "urgent",
    "college": "formal", "cryptocurrency": "analytical", "DIY": "creative", "education": "encouraging",
    "energy": "sustainable", "entertainment": "casual", "environment": "sustainable", "fashion": "trendy",
    "finance": "professional", "fitness": "motivational", "food": "enthusiastic", "gamer": "casual",
    "gaming": "excited", "gardening": "peaceful", "government": "official", "health": "empathetic",
    "history": "narrative", "home_decor": "aesthetic", "hospitality": "welcoming", "insurance": "reassuring",
    "legal": "authoritative", "literature": "expressive", "logistics": "precise", "manufacturing": "technical",
    "mental_health": "compassionate", "music": "passionate", "news": "neutral", "parenting": "supportive",
    "pets": "affectionate", "philosophy": "thoughtful", "photography": "artistic", "politics": "objective",
    "product": "detailed", "psychology": "insightful", "real_estate": "detailed",
    "relationships": "understanding", "retail": "helpful", "science": "analytical",
    "space_exploration": "inspiring", "sports": "energetic", "startup": "innovative",
    "technology": "informative", "technology_trends": "futuristic", "transport": "efficient",
    "travel": "adventurous", "videography": "cinematic", "wildlife": "conservationist",
}
GENERIC_WORDS = [
    "company", "service", "product", "furniture", "appliances", "electronics",
    "rental", "rent", "mojo", "about", "feature", "benefit",
]
GENERIC_TOPICS = ["product", "sales", "support"]
GENERIC_PERSONAS = ["customer support agent", "sales assistant", "product expert"]

# Persona -> (contexts, whole keywords), tried in order.
PERSONA_RULES = {
    "technical expert": (["technical"], ["api", "developer"]),
    "sales assistant": (["sales"], ["pricing", "product"]),
    "customer support agent": (["support"], ["customer", "support"]),
    "booking assistant": (["booking"], ["schedule", "booking"]),
    "educator": (["education"], ["educate", "teach"]),
    "troubleshooter": ([], ["troubleshoot", "error", "issue"]),
    "concierge": (["travel"], ["concierge"]),
    "legal advisor": (["legal"], ["legal"]),
    "hospitality expert": (["hospitality"], ["hospitality"]),
    "retail assistant": (["retail"], ["retail"]),
    "government official": (["government"], ["government"]),
}
SINGLE_PERSONAS = ["technical expert", "sales assistant", "customer support agent", "booking assistant"]

# Ranking of personas and topics; each row is (targets, context that fires it, cue words, points).
PERSONA_SCORES = [
    (["customer support agent"], "support", ["help", "issue", "support", "error", "not working", "fix"], 3),
    (["sales assistant"], "sales", ["buy", "price", "pricing", "order", "subscribe", "plan"], 3),
    (
        ["product expert", "technical expert"], None,
        ["product", "feature", "benefit", "spec", "specification", "compare"], 2,
    ),
]
TOPIC_SCORES = [
    (["sales"], None, ["buy", "price", "pricing", "order", "discount", "subscribe", "checkout"], 3),
    (["product"], None, ["product", "feature", "benefit", "spec", "compare", "details"], 3),
]
PERSONA_ORDER = [
    "customer support agent", "sales assistant", "product expert", "technical expert", "helpful assistant",
]
TOPIC_ORDER = ["product", "sales", "support", "technology", "general"]

# Three generations of energy words, and the case-sensitive marks of the two-way test.
ENERGY_WORDS = [
    "great", "awesome", "excited", "amazing", "urgent", "fantastic", "incredible", "wonderful", "super", "love",
    "wow", "yay", "cool", "excellent", "outstanding", "brilliant", "terrific", "spectacular", "unbelievable",
    "so happy", "so good", "so cool", "can't wait", "thrilled", "pumped", "ecstatic", "delighted", "impressive",
    "rock", "fire", "lit", "best ever", "phenomenal",
]
ENERGY_WORDS_SHORT = ["great", "awesome", "excited", "amazing", "urgent"]
ENERGY_WORDS_SHORTEST = ["great", "awesome", "excited"]
ENERGY_MARKS = ["!", "OMG", "wow", "awesome", "lit", "hype", "slay", "rizz", "savage", "flex", "yeet"]

# Cues of the prompt styles, tried in this order.
STYLE_TUTORIAL = ["let's start", "walk me through", "step by step", "tutorial", "lesson", "basics", "guide me"]
STYLE_NOT_CONCISE = ["please", "could you", "would you", "why", "how", "tell me"]
STYLE_CURIOUS = [
    "i've heard", "curious", "wonder", "why do", "why does", "why is", "why are",
    "why they", "why it", "what are they", "what makes",
]
STYLE_FRIENDLY = ["hey", "hi", "hello", "what exactly", "tell me more", "😊", "😀", "👋"]
STYLE_PROFESSIONAL = [
    "could you", "would you", "please", "assist", "provide", "kindly", "help me understand", "could i get",
]

# Words that signal logic in a prompt.
LOGIC_WORDS = ["and", "or", "if", "then", "else", "not", "except"]

# Single technical words of four letters or more (shorter or two-word terms can never match a
# token of the complexity test, so they are not listed).
TECHNICAL_WORDS = [
    "integration", "deployment", "database", "server", "framework", "library", "code", "algorithm", "model",
    "function", "parameter", "variable", "object", "class", "method", "error", "exception", "performance",
    "scalability", "optimization", "architecture", "protocol", "endpoint", "token", "authentication", "authorization",
    "encryption", "compression", "latency", "throughput", "bandwidth", "cloud", "container", "docker", "kubernetes",
    "microservice", "monolith", "distributed", "concurrent", "parallel", "thread", "process", "memory", "disk",
    "storage", "network", "socket", "port", "firewall", "cache", "queue", "message", "event", "stream", "batch",
    "pipeline", "data", "analytics", "visualization", "dashboard", "report", "schema", "table", "column", "index",
    "value", "json", "yaml", "toml", "config", "settings", "environment", "secret", "vault", "monitoring", "logging",
    "alert", "notification", "incident", "ticket", "support", "uptime", "downtime", "backup", "restore", "snapshot",
    "replication", "failover", "security", "compliance", "audit", "policy", "governance", "risk", "threat",
    "vulnerability", "patch", "update", "upgrade", "release", "version", "branch", "merge", "commit", "push", "clone",
    "fork", "issue", "feature", "task", "story", "epic", "sprint", "kanban", "scrum", "agile", "waterfall", "devops",
    "test", "mock", "stub", "assert", "coverage", "lint", "profiling", "benchmark", "trace", "debug", "print",
    "output", "input", "mobile", "desktop", "application", "service", "daemon", "agent", "worker", "scheduler",
    "cron", "timer", "callback", "promise", "future", "async", "await", "lock", "mutex", "semaphore", "deadlock",
    "starvation", "priority",
]

# Slang of the age groups, tried in order, with persona suffix and tone.
AGE_SLANG = {
    "gen alpha": [
        "slay", "rizz", "sus", "no cap", "bet", "skibidi", "gyatt", "sigma", "brainrot", "npc", "drip", "yeet",
    ],
    "gen z": [
        "fam", "vibe", "lit", "savage", "flex", "ghost", "stan", "lowkey", "highkey", "mood", "snatched",
    ],
    "millennial": [
        "adulting", "cringe", "hangry", "binge", "side hustle", "doggo", "selfie", "fomo", "tbh", "basic",
    ],
    "gen x": ["rad", "chill", "dude", "whatever", "yuppie", "gnarly", "poser", "phat", "wicked"],
    "boomer": ["groovy", "far out", "cool cat", "hip", "square", "right on", "dig it", "outta sight"],
}
AGE_INFO = {
    "gen alpha": ("Gen Alpha slang user", "brain-rot, energetic, modern"),
    "gen z": ("Gen Z slang user", "casual, energetic, modern"),
    "millennial": ("Millennial", "friendly, professional"),
    "gen x": ("Gen X", "professional, formal"),
    "boomer": ("Boomer", "formal, structured"),
}

# Domain -> operational context.
OPERATIONAL_CONTEXTS = {
    "support": "support", "technical": "technical", "sales": "sales", "booking": "booking",
    "education": "education", "health": "healthcare", "travel": "travel", "finance": "finance",
    "government": "government", "legal": "legal", "entertainment": "entertainment", "startup": "startup",
    "hospitality": "hospitality", "retail": "retail", "product": "product",
}

# Contraction -> expansion, applied in this order as literal replacements; every apostrophe left
# over is then dropped. The entries with odd bytes repair known encoding damage.
CONTRACTIONS = [
    ("he's", "he is"), ("there's", "there is"), ("We're", "We are"), ("That's", "That is"),
    ("won't", "will not"), ("they're", "they are"), ("Can't", "Cannot"), ("wasn't", "was not"),
    ("don\x890ªt", "do not"), ("aren't", "are not"), ("isn't", "is not"), ("What's", "What is"),
    ("haven't", "have not"), ("hasn't", "has not"), ("There's", "There is"), ("He's", "He is"),
    ("It's", "It is"), ("You're", "You are"), ("I'M", "I am"), ("shouldn't", "should not"),
    ("wouldn't", "would not"), ("i'm", "I am"), ("I\x89Û³m", "I am"), ("I'm", "I am"),
    ("Isn't", "is not"), ("Here's", "Here is"), ("you've", "you have"), ("you\x890ave", "you have"),
    ("we're", "we are"), ("what's", "what is"), ("couldn't", "could not"), ("we've", "we have"),
    ("it\x89Ûas", "it is"), ("doesn\x890at", "does not"), ("It\x890ªs", "It is"), ("Here\x89Ûas", "Here is"),
    ("who's", "who is"), ("I\x890ªve", "I have"), ("y'all", "you all"), ("can\x890at", "cannot"),
    ("would've", "would have"), ("it'll", "it will"), ("we'11", "we will"), ("wouldn\x890ªt", "would not"),
    ("We've", "We have"), ("he'11", "he will"), ("Y'all", "You all"), ("Weren't", "Were not"),
    ("Didn't", "Did not"), ("they'11", "they will"), ("they'd", "they would"), ("DON'T", "DO NOT"),
    ("That\x890ªs", "That is"), ("they've", "they have"), ("i'd", "I would"), ("should've", "should have"),
    ("You\x89Û³re", "You are"), ("where's", "where is"), ("Don\x890ªt", "Do not"), ("we'd", "we would"),
    ("i'll", "I will"), ("weren't", "were not"), ("They're", "They are"), ("Can\x890", "Cannot"),
    ("you'll", "you will"), ("I'd", "I would"), ("let's", "let us"), ("it's", "it is"),
    ("can't", "cannot"), ("don't", "do not"), ("you're", "you are"), ("i've", "I have"),
    ("that's", "that is"), ("doesn't", "does not"), ("didn't", "did not"), ("ain't", "am not"),
    ("I've", "I have"), ("Don't", "do not"), ("I'll", "I will"), ("Let's", "Let us"),
    ("you'd", "You would"), ("Ain't", "am not"), ("Haven't", "Have not"), ("Could've", "Could have"),
    ("youve", "you have"), ("donårt", "do not"), ("'", ""),
]

# Phrases that betray leaked instructions in a response.
LEAKED_PHRASES = [
    "Provide a comprehensive answer",
    "If the solution involves multiple steps, explain them clearly",
    "Start directly with the answer",
]
BANNED_RESPONSE = "Not available in training data."

# Markup removed before the pair rules look at a page, by rule generation.
NOISE_TAGS = [
    "script", "style", "noscript", "iframe", "template", "nav", "footer", "form", "button", "input", "svg",
]
NOISE_TAGS_WIDE = [
    "head", "script", "style", "nav", "footer", "header", "form", "noscript", "iframe", "button", "input",
    "aside", "svg", "canvas", "link", "meta",
]
NOISE_NAMES = [
    "footer", "header", "nav", "toc", "sidebar", "masthead", "menu", "cookies", "ads", "advertisement",
    "promo", "newsletter",
]
NOISE_TAGS_TEXT = ["script", "style", "nav", "footer", "header", "form", "aside", "noscript", "iframe", "h1"]
NOISE_IDS_TEXT = ["footer", "header", "sidebar", "navigation"]
