"""Fixed values.

Every word list, lookup value, label, weight and seed row below is a fixed value: results are
only right when they are exactly these.  Nothing here is computed.
"""

# Whitespace as Python's str.strip and re see it: body of a Java character class.
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same without the line feed, for patterns that must stay on one line.
WS_INLINE = r"\t\x0b-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same as plain characters, for btrim.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

LABELS = ["legitimo", "spam", "sospechoso"]  # class id = position
SOURCES = ["whitelist", "knn", "llm"]

# Headers that always start a new line, even in the middle of a flattened export.
LINE_STARTING_HEADERS = [
    "From:", "To:", "Subject:", "Date:", "Message-ID:", "Reply-To:", "Content-Type:",
    "Content-Transfer-Encoding:", "Thread-Topic:", "Thread-Index:", "Accept-Language:",
    "Content-Language:", "MIME-Version:", "Received:", "X-MS-", "x-ms-",
]

QUESTIONABLE_URLS_MARK = "# Questionable URLs detected in message:"

# Searched in subject and body; only the first hit in this order is reported.
PHISHING_KEYWORDS = [
    "urgent", "verify", "suspend", "security alert", "confirm identity", "update payment",
    "account locked", "unusual activity", "click here", "limited time", "act now", "prize",
    "winner", "congratulations", "urgente", "verificar", "suspender", "alerta de seguridad",
    "confirmar identidad", "actualizar pago", "cuenta bloqueada", "actividad inusual",
    "haz clic", "tiempo limitado", "actúa ahora", "premio", "ganador", "felicitaciones",
]

# Counted in the subject for the feature vector.
SUBJECT_KEYWORDS = [
    "pago", "urgente", "verify", "suspend", "security alert", "confirm identity",
    "update payment", "account locked", "unusual activity", "prize", "winner",
    "congratulations", "felicitaciones", "ganador", "verificar", "ciberseguridad",
    "contraseña", "password", "click here", "limited time", "act now", "factura", "invoice",
    "transferencia",
]

# Looked for anywhere in the body by the heuristic validator.
HEURISTIC_WORDS = [
    "verify", "confirm", "urgent", "suspended", "password", "click here", "update payment",
    "security alert", "account locked", "unusual activity",
]

SHORTENER_HOSTS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "short.link"]
SHORTENER_SUBSTRINGS = SHORTENER_HOSTS + ["rb.gy", "cutt.ly"]
HEURISTIC_SHORTENERS = ["bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly"]

HIGH_RISK_COUNTRIES = ["RU", "CN", "KP", "IR", "NG", "BY", "UA"]
SUSPICIOUS_MAILERS = ["", "unknown", "none", "test", "false"]
# (text every match contains, lower-cased; pattern)
OBFUSCATION_PATTERNS = [
    ("&#", r"&#\p{Nd}+;"),
    ("\\x", r"(?i)\\x[0-9a-f]{2}"),
    ("btoa(", r"(?i)btoa\("),
    ("eval(", r"(?i)eval\("),
]
CRITICAL_HEADERS = ["From", "Subject", "Message-ID"]

AUTH_PROTOCOLS = ["spf", "dkim", "dmarc"]
AUTH_RESULTS = ["pass", "fail", "none", "softfail", "neutral"]
RECEIVED_SPF_RESULTS = ["pass", "fail", "softfail", "none", "neutral"]
FEATURE_AUTH_RESULTS = [
    "pass", "fail", "softfail", "none", "neutral", "permerror", "temperror",
]

FEATURE_NAMES = [
    "spf_fail", "spf_softfail", "dkim_none", "dmarc_none", "auth_all_pass", "compauth_fail",
    "scl_high", "scl_negative", "sfv_spam", "sfv_skip", "cat_spoof", "cat_phish", "cat_none",
    "subject_keywords", "subject_very_short",
    "reply_to_mismatch", "high_risk_country", "ipv_nli", "return_path_mismatch",
    "x_originating_ip_mismatch", "sender_domain_suspicious", "encoding_suspicious",
    "url_count_norm", "ms_urls_detected", "short_urls",
    "has_attachment", "thread_hijacking", "display_name_mismatch", "form_in_email",
    "html_obfuscation", "multipart_suspicious", "received_hops", "x_mailer_suspicious",
]

# Label remapping of free-text answers: first key (in this order) contained in the label wins.
RESPONSE_LABEL_MAP = [
    ("spam", "spam"), ("marketing", "spam"), ("legitimo", "spam"), ("legit", "spam"),
    ("genuine", "spam"), ("phishing", "sospechoso"), ("malicious", "sospechoso"),
    ("suspicious", "sospechoso"), ("sospecho", "sospechoso"),
]
RESPONSE_LABELS = ["spam", "sospechoso"]

# Risk weights.
RISK_SPF = {"fail": 25, "softfail": 15, "none": 10}
RISK_DKIM = {"fail": 25, "softfail": 15, "none": 10}
RISK_DMARC = {"fail": 15, "none": 8}
RISK_QUESTIONABLE_URL = 35
RISK_PER_REASON, RISK_REASON_CAP = 7, 25
RISK_URL_STEPS = [(10, 10), (5, 5)]  # more than n URLs -> points
RISK_ABUSE_STEPS = [(80, 20), (50, 10), (20, 5)]  # score of at least n -> points
RISK_HOMOGRAPH = 30
RISK_CAP = 100

# Texts shown to people.
WHITELIST_REASON = "Dominio en whitelist — clasificado automáticamente como legítimo"
NOTICE_TEXT = {
    "legitimo": "✅ El email que reportaste fue revisado y clasificado como LEGÍTIMO.\n"
                "Remitente: %s\nAsunto: %s\nNo se requiere ninguna acción adicional.",
    "spam": "📧 El email fue clasificado como SPAM.\nRemitente: %s\nAsunto: %s\n"
            "Ha sido registrado para mejorar los filtros. No hay riesgo de seguridad.",
    "sospechoso": "⚠️ El email fue identificado como SOSPECHOSO / PHISHING.\n"
                  "Remitente: %s\nAsunto: %s\nScore de riesgo: %d/100\n"
                  "Nuestro equipo de seguridad ya fue notificado. POR FAVOR NO hagas clic "
                  "en enlaces ni descargues archivos de ese email.",
}

# Confidence threshold by training-set size: below n rows -> threshold.
THRESHOLD_STEPS = [(50, 0.95), (200, 0.85), (500, 0.75)]
THRESHOLD_FLOOR = 0.65

# Seed training rows in order: (33-vector, class id).
SEED_TRAINING = [
    ([0,0,0,0,1, 0,0,1,0,1, 0,0,1,0.33,0, 0,0,0,0,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 0),
    ([0,0,0,0,1, 0,0,1,0,1, 0,0,1,0,0, 0,0,0,0.1,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 0),
    ([0,0,0,0,1, 0,0,0,0,1, 0,0,1,0,0, 0,0,0,0.3,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 0),
    ([0,0,0,0,1, 0,0,1,0,1, 0,0,1,0,0, 0,0,0,0,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 0),
    ([0,0,0,0,1, 0,0,0,0,0, 0,0,1,0,0, 0,0,0,0.4,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 0),
    ([0,0,1,1,0, 0,0,0,0,0, 0,0,1,0,0, 0,0,0,0.5,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 1),
    ([0,1,0,1,0, 0,1,0,1,0, 0,0,1,0,0, 0,0,1,0.2,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 1),
    ([0,1,0,1,0, 0,1,0,1,0, 0,0,1,0.33,0, 0,0,0,0.6,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 1),
    ([0,0,1,0,0, 0,0,0,0,0, 0,0,1,0,0, 0,0,0,0.3,0, 0,0,0,0, 0,0,0,0,0,0,0,0,0], 1),
    ([1,0,1,1,0, 1,1,0,1,0, 1,0,0,0.33,1, 0,0,1,0,0, 0,1,1,0, 0,0,0,0,1,0,1,0,0], 2),
    ([1,0,1,1,0, 1,1,0,1,0, 1,0,0,0.66,0, 0,0,1,0.2,0, 0,0,0,1, 0,0,0,0,1,0,1,0,0], 2),
    ([0,1,0,1,0, 0,1,0,1,0, 0,0,1,0.33,0, 0,0,0,0.4,1, 0.5,0,0,0, 0,0,0,1,1,0,0,0,0], 2),
    ([1,0,1,1,0, 1,1,0,1,0, 1,0,0,0,0, 0,1,1,0,0, 0,1,1,0, 0,0,0,0,1,0,1,0,0], 2),
    ([1,0,1,1,0, 1,1,0,1,0, 1,0,0,0,0, 1,1,1,0.1,0, 0,0,0,0, 0,0,0,0,1,0,1,0,0], 2),
    ([1,0,1,0,0, 0,1,0,1,0, 0,0,1,0.66,0, 0,0,1,0.3,0, 1,0,0,1, 0,0,0,0,1,0,1,0,0], 2),
]
