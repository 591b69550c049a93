"""Plans that analyse texts; ``samples`` holds sentences that exercise what invented prose does not."""

from quaestor.functions import lexicons as L
from quaestor.functions import text as T

#: Our own sentences.
SAMPLES = [
    ("wire_memo.txt", "Memo. Dear client, split the payment and keep it under the limit: $9,500 by wire transfer to the offshore holding company LLC. Account number: 12345678. Keep this quiet, off the books."),
    ("deposition_smith.pdf", "Deposition of John Smith. Q. Do you swear? A. I do. The witness was deposed under oath on March 14, 2009. I don't remember, no comment, that depends."),
    ("flight_log.csv", "Flight log and passenger manifest. Tail number N123AB, departure Paris, arrival London. The aircraft left in 2003, two weeks later."),
    ("notice.eml", "From: a@b.org To: c@d.org Subject: final warning. This is urgent, handle this immediately or else legal action. The package and the shipment for our friend: $2,000, $3,000 and $4,000 in cash deposits."),
    ("bank.txt", "SWIFT DEUTDEFF, EIN 12-3456789, routing number 021000021. The bank account and the loan; invest the fund, audit the tax. $12,000 and $450 and $1,000.00."),
    ("empty.txt", ""),
    ("report.txt", "Incident report, case number 77. The detective and the reporting officer met. The detective and the reporting officer left. Surveillance of the property; hawala, bitcoin and a mixer in Panama and Cyprus."),
]

_LOW = "WITH t AS (SELECT id, filename, text, lower(text) AS low, lower(substr(text, 1, 5000)) AS head, lower(filename) AS low_name, {words} AS words FROM {{samples}} UNION ALL SELECT 1000 + id, 'text', text, lower(text), lower(substr(text, 1, 5000)), 'text', {words} FROM {{texts}})".replace("{words}", "WORDS(text)").replace("{{", "{").replace("}}", "}")


def _list(values) -> str:
    return "ARRAY_OF(" + ", ".join(map(T.quoted, values)) + ")"


def _labels(groups: dict[str, list[str]], rate: float) -> str:
    """(id, label, hits, score) of the groups that occur, in one scan: a text's counts make one array, which then becomes rows."""
    counts = ", ".join(f"LABELLED({T.quoted(g)}, {T.hits('low', words)})" for g, words in groups.items())
    return f"SELECT id, x.label AS label, x.hits AS hits, {T.share('low', 'x.hits', rate)} AS score FROM (SELECT id, words, UNNESTED(ARRAY_OF({counts})) AS x FROM t) e WHERE x.hits > 0"


def _severity(words: list[str], least: int, high: int | None) -> str:
    n = T.present("low", words)
    return f"CASE WHEN {n} >= {high} THEN 'high' WHEN {n} >= {least} THEN 'medium' END" if high else f"CASE WHEN {n} >= {least} THEN 'medium' END"


_ROUND = f"COUNTED(ALLMATCHES(text, '{L.ROUND_AMOUNT}', 1), '^[0-9,]*[0-9],000(\\.00)?$')"
#: Flag -> its severity, null where the text does not raise it.
_SEVERITIES = {
    "structuring": f"CASE WHEN {T.present('low', L.STRUCTURING)} > 0 OR " + " OR ".join(f"MATCHES(text, '{p}')" for p in L.STRUCTURING_AMOUNTS) + " THEN 'high' END",
    "shell_company": _severity(L.SHELL_COMPANY, 2, 4),
    "layering": _severity(L.LAYERING, 1, 3),
    "high_risk_jurisdiction": _severity(L.JURISDICTIONS, 1, None),
    "secrecy_concealment": _severity(L.SECRECY, 1, 3),
    "round_number_transactions": f"CASE WHEN {_ROUND} >= 3 THEN 'low' END",
}
_FLAGS = "SELECT id, flag, severity FROM (SELECT id, flag, CASE flag " + " ".join(f"WHEN '{f}' THEN {e}" for f, e in _SEVERITIES.items()) + f" END AS severity FROM (SELECT id, text, low, UNNESTED({_list(_SEVERITIES)}) AS flag FROM t) e) s WHERE severity IS NOT NULL"
_AMOUNT = "CAST(replace(a, ',', '') AS DOUBLE)"
#: Word ends that both engines see alike, beyond ASCII too; spaces are doubled for what they take.
_ALONE, _END = r"(?:^|[^\pL\pN_])", r"(?:$|[^\pL\pN_])"
_MONEY = f"""SELECT DISTINCT id, 'currency_amount' AS type, a AS value, CASE WHEN {_AMOUNT} >= 9000 AND {_AMOUNT} < 10000 THEN 90 WHEN {_AMOUNT} >= 10000 THEN 50 WHEN {_AMOUNT} >= 1000 AND {_AMOUNT} = 1000 * floor({_AMOUNT} / 1000) THEN 30 ELSE 0 END AS percent
    FROM (SELECT id, UNNESTED(ALLMATCHES(text, '{L.CURRENCY}', 1)) AS a FROM t) x WHERE {_AMOUNT} >= 500
    UNION SELECT id, 'account_number', UNNESTED(ALLMATCHES(text, '(?i){L.ACCOUNT}', 1)), 40 FROM t UNION SELECT id, 'routing_number', UNNESTED(ALLMATCHES(text, '(?i){L.ROUTING}', 1)), 40 FROM t
    UNION SELECT id, 'swift_code', UNNESTED(ALLMATCHES(replace(text, ' ', '  '), '{_ALONE}{L.SWIFT[2:-2]}{_END}', 1)), 50 FROM t UNION SELECT id, 'ein', UNNESTED(ALLMATCHES(text, '{L.EIN}', 1)), 20 FROM t"""
_CODES = f"SELECT id, word, {T.count_of('low', 'word')} AS n FROM (SELECT id, low, UNNESTED({_list(L.CODEWORDS)}) AS word FROM t) e WHERE contains(low, word)"

PLANS = {
    # the category with most signals in the first 5 000 characters, the first of equals; below two: other
    "classify_document": f"{_LOW} SELECT id, CASE WHEN max(x.hits) <= 100 THEN 'other' ELSE max_by(x.label, x.hits) END AS category FROM (SELECT id, UNNESTED(ARRAY_OF(" + ", ".join(f"LABELLED('{c}', 100 * {T.category_score('head', 'low_name', words)} - {k})" for k, (c, words) in enumerate(L.CATEGORIES.items())) + ")) AS x FROM t) e GROUP BY id",
    "classify_intent": f"{_LOW} {_labels(L.INTENTS, 0.01)}",
    "classify_topics": f"{_LOW} SELECT id, label, hits, score FROM (SELECT id, label, hits, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS rank FROM ({_labels(L.TOPICS, 0.005)}) x) y WHERE rank <= 5",
    "detect_aml_flags": f"{_LOW} {_FLAGS}",
    "extract_financial_indicators": f"{_LOW} {_MONEY}",
    # one row a text, one scan
    "compute_risk_score": f"""{_LOW}, f AS (SELECT id, words, """ + ", ".join(f"{e} AS {f}" for f, e in _SEVERITIES.items()) + f""", COUNTED(DISTINCTS(ALLMATCHES(text, '{L.CURRENCY}', 1)), '^9,[0-9]{{3}}') AS risky,
        {T.present('low', L.CODEWORDS)} AS codes, {T.hits('low', L.INTENTS['evasive'])} AS evasive, {T.hits('low', L.INTENTS['threatening'])} AS threatening FROM t),
        g AS (SELECT id, """ + ", ".join("(" + " + ".join(f"CASE WHEN {f} = '{v}' THEN 1 ELSE 0 END" for f in _SEVERITIES) + f") AS {v}" for v in ("high", "medium", "low")) + f""", risky, codes,
        {T.share('', 'evasive', 0.01)} AS evasive, {T.share('', 'threatening', 0.01)} AS threatening FROM f) SELECT id, {T.risk('high', 'medium', 'low', 'risky', 'codes', 'evasive', 'threatening')} AS risk FROM g""",
    "analyze_tone": f"{_LOW} SELECT id, " + ", ".join(f"{T.tone('low', words)} AS {g}" for g, words in L.TONES.items()) + " FROM t",
    "document_ocr_quality": "SELECT id, round(CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS DOUBLE) / length(text), 6) AS alpha, round(CAST(length(regexp_replace(text, '[^ ]', '', 'g')) AS DOUBLE) / length(text), 6) AS space FROM {texts} WHERE length(text) > 0",
    "html_to_text": "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM {pages}",
}
