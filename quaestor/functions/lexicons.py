"""Word lists and patterns of the text functions: fixed values."""

STRUCTURING = ["split the payment", "break it up", "break up the", "multiple transactions", "several payments", "under the limit", "below the threshold", "keep it under", "reporting requirement", "avoid report", "structured", "structuring", "smurfing", "cash deposit", "cash deposits", "money order", "money orders", "cashier's check", "cashier check", "traveler's check"]
STRUCTURING_AMOUNTS = [r"\$\s*9[,.]?[0-9]{3}(?:\.\d{2})?", r"\$\s*4[,.]?[0-9]{3}(?:\.\d{2})?"]
ROUND_AMOUNT = r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.00)?)\b"
SHELL_COMPANY = ["llc", "holding company", "holdings", "offshore", "registered agent", "nominee director", "nominee shareholder", "bearer share", "shelf company", "shell company", "special purpose vehicle", "spv", "special purpose entity", "beneficial owner", "ultimate beneficial owner", "ubo", "trust account", "blind trust", "irrevocable trust", "foundation", "stiftung", "anstalt"]
LAYERING = ["wire transfer", "wire from", "wire to", "wired funds", "convert to", "convert the", "exchange for", "cryptocurrency", "bitcoin", "btc", "ethereum", "eth", "usdt", "tether", "monero", "crypto wallet", "wallet address", "mixer", "tumbler", "correspondent bank", "intermediary bank", "nostro account", "vostro account", "back-to-back loan", "round-tripping", "trade-based", "over-invoice", "under-invoice", "mispricing", "hawala", "hundi", "fei ch'ien"]
JURISDICTIONS = ["cayman islands", "british virgin islands", "bvi", "panama", "bermuda", "jersey", "guernsey", "isle of man", "liechtenstein", "monaco", "andorra", "seychelles", "mauritius", "vanuatu", "samoa", "marshall islands", "belize", "nevis", "st. kitts", "turks and caicos", "bahamas", "luxembourg", "switzerland", "dubai", "uae", "singapore", "hong kong", "cyprus", "malta", "labuan", "curacao", "aruba", "cook islands", "niue", "nauru", "myanmar", "north korea", "iran", "syria", "yemen", "afghanistan", "somalia"]
SECRECY = ["off the record", "off the books", "keep this quiet", "don't tell", "do not tell", "delete this", "burn after reading", "destroy this", "confidential", "eyes only", "not for distribution", "private channel", "secure line", "encrypted", "use signal", "use telegram", "burner", "prepaid phone", "no paper trail", "plausible deniability", "clean", "discreet", "discretion", "hush money", "quiet payment", "under the table", "off-book", "black money", "slush fund"]
INTENTS = {
    "transactional": ["invoice", "payment", "receipt", "purchase", "sale", "transfer", "amount due", "balance", "fee", "commission", "disbursement", "remittance", "payable", "receivable", "billing", "credit", "debit"],
    "coordinating": ["meeting", "schedule", "arrange", "coordinate", "confirm", "agenda", "action item", "follow up", "next steps", "call me", "let's discuss", "set up", "plan for", "deadline", "deliverable"],
    "evasive": ["hypothetically", "in theory", "if someone were to", "not saying", "i'm not sure", "can't recall", "don't remember", "no comment", "plead the fifth", "on advice of counsel", "decline to answer", "i would have to check", "that depends", "it's complicated", "you know what i mean", "between us", "off the record"],
    "threatening": ["or else", "consequence", "you will regret", "final warning", "last chance", "demand", "ultimatum", "expose", "go public", "authorities", "lawyer up", "legal action", "lawsuit", "subpoena", "leverage", "insurance policy", "dead man's switch"],
    "informational": ["report", "update", "summary", "analysis", "findings", "attached", "enclosed", "for your review", "fyi", "please note", "per our discussion", "as discussed", "background", "briefing", "memo"],
    "directive": ["make sure", "ensure that", "i need you to", "handle this", "take care of", "get it done", "asap", "immediately", "urgent", "priority", "do not delay", "expedite", "move on this"],
}
TOPICS = {
    "financial": ["bank", "account", "transfer", "payment", "money", "fund", "invest", "capital", "asset", "loan", "mortgage", "interest", "dividend", "revenue", "profit", "loss", "tax", "audit", "compliance", "fiduciary"],
    "legal": ["attorney", "lawyer", "court", "judge", "plaintiff", "defendant", "motion", "filing", "statute", "regulation", "indictment", "prosecution", "defense", "testimony", "deposition", "discovery", "subpoena", "verdict", "settlement"],
    "political": ["campaign", "election", "vote", "delegate", "caucus", "primary", "donor", "fundrais", "pac", "lobby", "legislation", "senator", "congress", "governor", "cabinet", "policy", "diplomat", "ambassador", "sanction"],
    "intelligence": ["surveillance", "classified", "clearance", "operative", "asset", "handler", "intelligence", "counterintelligence", "intercept", "sigint", "humint", "reconnaissance", "briefing", "debriefing", "informant", "source"],
    "real_estate": ["property", "deed", "title", "parcel", "acreage", "zoning", "tenant", "lease", "rental", "mortgage", "escrow", "closing", "appraisal", "renovation", "construction", "development"],
    "travel": ["flight", "airport", "passenger", "itinerary", "travel", "visa", "passport", "customs", "border", "hotel", "yacht", "charter", "manifest", "departure", "arrival", "destination"],
    "communication": ["email", "phone", "call", "text", "message", "correspondence", "memo", "letter", "fax", "meeting", "conference", "briefing"],
    "criminal": ["trafficking", "smuggling", "conspiracy", "fraud", "embezzlement", "bribery", "extortion", "racketeering", "obstruction", "perjury", "forgery", "counterfeit", "launder", "kickback", "corruption"],
}
CODEWORDS = ["pizza", "pasta", "cheese", "ice cream", "candy", "party", "package", "shipment", "delivery", "sample", "product", "material", "stuff", "thing", "item", "gift", "donation", "contribution", "consulting fee", "consulting", "advisory fee", "entertainment", "hospitality", "favor", "arrangement", "understanding", "our friend", "the guy", "the man", "the client", "the project", "the situation", "the matter", "the issue", "special project", "side project"]
CATEGORIES = {
    "deposition": ["deposition", "deposed", "sworn testimony", "q.", "a.", "direct examination", "cross examination", "the witness", "under oath", "do you swear"],
    "flight": ["flight log", "manifest", "passenger", "tail number", "departure", "arrival", "aircraft", "gulfstream", "boeing", "n908je", "n212jl", "teterboro"],
    "correspondence": ["dear", "sincerely", "regards", "re:", "from:", "to:", "cc:", "memorandum", "memo", "letter"],
    "report": ["incident report", "case number", "reporting officer", "investigation", "detective", "fbi", "police report", "supplemental report", "field report"],
    "legal": ["plaintiff", "defendant", "motion", "court order", "filed", "docket", "case no", "civil action", "complaint", "indictment", "plea agreement", "non-prosecution agreement", "npa"],
    "email": ["subject:", "from:", "to:", "cc:", "date:", "message-id:", "mime-version", "content-type", "sent from my", "forwarded message", "on behalf of", "original message"],
    "lobbying": ["fara", "foreign agent", "lobbying disclosure", "lobbying activity", "registrant", "client", "lobbying firm", "government relations", "foreign principal", "political activity", "supplemental statement"],
}
TONES = {
    "threat": ["threat", "warn", "danger", "risk", "harm", "attack", "violent", "kill", "weapon"],
    "urgency": ["urgent", "immediately", "asap", "critical", "emergency", "deadline", "rush", "time-sensitive"],
    "evasion": ["deny", "refuse", "decline", "no comment", "plead the fifth", "i don't recall", "i don't remember", "cannot recall", "i have no"],
    "legal_exposure": ["liability", "lawsuit", "prosecution", "criminal", "indictment", "guilty", "plaintiff", "defendant", "settlement", "subpoena"],
    "financial": ["payment", "transfer", "wire", "account", "fund", "invest", "dollar", "million", "billion", "transaction"],
    "secrecy": ["confidential", "secret", "classified", "private", "restricted", "do not distribute", "off the record", "between us"],
}
PHRASE_STOPS = ["the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "was", "were", "are", "be"]
CURRENCY = r"\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:million|billion|thousand|[MBKmk])?"
ACCOUNT = r"\b(?:account\s*(?:#|no\.?|number)?\s*[:.]?\s*)(\d{4,20})\b"
ROUTING = r"\b(?:routing\s*(?:#|no\.?|number)?\s*[:.]?\s*)(\d{9})\b"
SWIFT = r"\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
EIN = r"\b(\d{2}-\d{7})\b"
MONTHS = r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
#: (pattern, precision, confidence), most specific first.
DATES = [
    (rf"({MONTHS})\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})", "day", 0.95),
    (rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTHS}),?\s+(\d{{4}})", "day", 0.95),
    (r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})", "day", 0.85),
    (r"(\d{4})-(\d{2})-(\d{2})", "day", 0.95),
    (r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{2})(?!\d)", "day", 0.70),
    (rf"({MONTHS}),?\s+(\d{{4}})", "month", 0.80),
    (r"(Spring|Summer|Fall|Autumn|Winter)\s+(?:of\s+)?(\d{4})", "season", 0.70),
    (r"(?:in|during|around|circa|since|before|after|by)\s+(\d{4})(?!\d)", "year", 0.60),
    (rf"(?:approximately|approx\.?|around|circa|roughly)\s+(?:({MONTHS})\s+)?(\d{{4}})", "approx", 0.50),
]
RELATIVE_DATES = [
    r"(?:the\s+)?(?:following|next|previous|prior)\s+(?:day|week|month|year|Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)",
    r"(?:\d+|two|three|four|five|six|seven|eight|nine|ten)\s+(?:days?|weeks?|months?|years?)\s+(?:later|earlier|before|after|prior)",
    r"(?:the\s+)?(?:same|that)\s+(?:day|week|month|year|evening|morning|afternoon|night)",
    r"(?:shortly|soon|immediately)\s+(?:after|before|thereafter|prior)",
]
RELATIVE_CONFIDENCE = 0.30
SEASONS = {"spring": "03", "summer": "06", "fall": "09", "autumn": "09", "winter": "12"}
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Sir", "Judge", "Hon", "Rev", "Sen", "Rep", "Gov", "Gen", "Col", "Capt", "Lt", "Sgt", "Det", "Agent"]
ORGANISATIONS = ["Inc", "LLC", "Ltd", "Corp", "Corporation", "Company", "Co", "Bank", "Group", "Foundation", "Trust", "Partners", "Holdings", "University", "Institute", "Department", "Agency", "Bureau", "Commission", "Association"]
