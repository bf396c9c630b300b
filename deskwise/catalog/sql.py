"""Building blocks of the SQL the checks run; they restate the operators in plain SQL."""

from deskwise.functions import lexicon as lx

WS = r"\s\x0B\x1C-\x1F\x85\p{Z}"
W = r"\p{L}\p{N}_"


# The entities that the test tables hold; the ampersand has to come last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
    ("&trade;", "™"), ("&middot;", "·"), ("&hellip;", "…"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"),
    ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"),
    ("&euro;", "€"), ("&pound;", "£"), ("&amp;", "&"),
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def str_list(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def in_list(items) -> str:
    return "(" + ", ".join(lit(i) for i in items) + ")"


def sub(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {lit(by)}, 'g')"


def decode(expr: str) -> str:
    for entity, char in ENTITIES:
        expr = f"replace({expr}, {lit(entity)}, {lit(char)})"
    return expr


URL = {
    "strict": rf"https?://[^{WS}]+|www\.[^{WS}]+",
    "runtime": rf"https?://[^{WS}]+",
    "cluster": rf"http[^{WS}]+|www[^{WS}]+",
}
SIGN = {
    "strict": (rf"[{WS}]*\^[A-Za-z]{{1,4}}[{WS}]*\z", ""),
    "runtime": (r"\^[A-Z]{1,3}\b", " "),
}


def squeeze(expr: str) -> str:
    return f"trim({sub(expr, f'[{WS}]+', ' ')})"


def strip(expr: str) -> str:
    return sub(expr, rf"\A[{WS}]+|[{WS}]+\z", "")


def escapes(expr: str) -> str:
    return rf"replace(replace({expr}, '\n', ' '), '\t', ' ')"


def clean(expr: str, profile: str) -> str:
    text = sub(decode(f"coalesce({expr}, '')"), URL[profile], " ")
    text = sub(text, f"@[{W}]+", " ")
    pattern, by = SIGN[profile]
    return squeeze(escapes(sub(text, pattern, by)))


def contains_any(expr: str, terms) -> str:
    return "(" + " OR ".join(f"contains(lower({expr}), {lit(t)})" for t in terms) + ")"


def ack(expr: str, phrases=lx.ACKNOWLEDGEMENTS) -> str:
    return f"({sub(strip(f'lower({expr})'), f'[^{W}{WS}]', '')} IN {in_list(phrases)})"


def language_share(expr: str, lang: str = "en") -> str:
    words = f"regexp_extract_all(lower({expr}), '[{W}]+')"
    hits = {
        code: f"len([w for w in {words} if list_contains({str_list(ws)}, w)])"
        for code, ws in lx.FUNCTION_WORDS.items()
    }
    total = " + ".join(hits.values())
    return f"coalesce({hits[lang]}::DOUBLE / nullif(({total})::DOUBLE, 0), 0.0::DOUBLE)"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


PAIRS = """pairs AS (
  SELECT conv_id, turn, conv_id * 4294967296 + turn AS pos,
         conv_id || '-' || turn AS message_id, text AS customer_message,
         conv_id || '-' || next_turn AS response_id, next_text AS agent_response
  FROM (SELECT *, lead(turn) OVER w AS next_turn, lead(text) OVER w AS next_text, lead(role) OVER w AS next_role
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

# A message table in which every cleaning rule has something to do, derived from documents.
NOISY = r"""noisy AS (
  SELECT doc_id, '@' || source || ' ' || text || ' &amp;lt;tag&gt; http://t.example/' || doc_id
         || ' www.example.org/' || lang || chr(10) || ' line\nbreak\tend' || chr(160)
         || '^AB, ^' || upper(lang) || '  ' AS message, lang, source
  FROM documents)"""

REVIEWED = """reviewed AS (
  SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

INTENT = f"({str_list(lx.INTENTS)})[label + 1]"

VECTORS = f"""v AS (
  SELECT vec_id, {INTENT} AS true_intent, embedding::DOUBLE[] AS e FROM embeddings)"""

CENTROIDS = """parts AS (
  SELECT true_intent, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
sums AS (SELECT true_intent AS label, i, sum(x) AS s, count(*) AS n FROM parts GROUP BY ALL),
cent AS (SELECT label, any_value(n) AS n, list(s ORDER BY i) AS total FROM sums GROUP BY label)"""

# Leave-one-out centroid scores, prediction and softmax confidence for every vector.
PREDICTED = """scores AS (
  SELECT v.vec_id, v.true_intent, c.label,
         round(CASE WHEN c.label <> v.true_intent THEN list_dot_product(v.e, c.total) / c.n
                    WHEN c.n > 1 THEN (list_dot_product(v.e, c.total) - list_dot_product(v.e, v.e))
                                      / (c.n - 1)
                    ELSE 0 END, 6) AS s
  FROM v CROSS JOIN cent c),
pred AS (
  SELECT vec_id, any_value(true_intent) AS true_intent,
         first(label ORDER BY s DESC, label) AS predicted_intent,
         round(1 / sum(exp(10 * (s - m))), 6) AS confidence
  FROM (SELECT *, max(s) OVER (PARTITION BY vec_id) AS m FROM scores) GROUP BY vec_id)"""

CANDIDATES = """sim AS (
  SELECT q.vec_id AS query_id, h.vec_id AS history_id,
         round(list_dot_product(q.e, h.e), 6) AS similarity
  FROM v q JOIN v h ON q.vec_id <> h.vec_id),
cand AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, history_id)
            AS semantic_rank
  FROM sim QUALIFY semantic_rank <= 50)"""

CASES = """scored AS (
  SELECT c.*, h.predicted_intent AS intent, h.confidence AS intent_confidence, q.predicted_intent,
         q.true_intent, (h.predicted_intent = q.predicted_intent)::INTEGER AS intent_match
  FROM cand c JOIN pred h ON h.vec_id = c.history_id JOIN pred q ON q.vec_id = c.query_id),
cases AS (
  SELECT *, round(0.8::DOUBLE * similarity + 0.2::DOUBLE * intent_match, 6) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY
           round(0.8::DOUBLE * similarity + 0.2::DOUBLE * intent_match, 6) DESC, semantic_rank)
           AS rank
  FROM scored QUALIFY rank <= 5)"""

RETRIEVE = (VECTORS, CENTROIDS, PREDICTED, CANDIDATES, CASES)
CLASSIFY = (VECTORS, CENTROIDS, PREDICTED)
