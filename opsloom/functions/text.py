"""Text as Column expressions: folding, templates, fingerprints, scrubbing, severities.

Everything stays in the JVM; no function here is a Python UDF.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities, from least to most.
SEVERITIES = ("DEBUG", "INFO", "WARN", "ERROR", "CRITICAL")
# Masks of a message's variable parts, in their order of precedence.
MASKS = (
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b", "<ip>"),
    (r"\b[0-9a-f]{16,}\b", "<hex>"),
    (r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}[^\s]*", "<ts>"),
    (r"https?://\S+", "<url>"),
    (r"(?<=[\s=:/])/[\w./\-]+", "<path>"),
    (r"\b\d+(?:\.\d+)?\s?(?:ms|s|sec|m|h|%|kb|mb|gb)\b", "<n>"),
    (r"\b\d+\b", "<n>"),
)
# What the first six masks, and white space that is more than a space, cannot do without: a text that has none of these is masked by the last two alone.
LONG_MASKS = r"[/\t\n\x0B\f\r]|  |(?i:https?:)|(?i:[0-9a-f]{8}(?:-|[0-9a-f]{8}))|\d\.\d{1,3}\.\d|\d{4}-\d{2}-\d{2}[T ]"
# Words for each severity.
DEBUG_WORDS = ("trace", "debug", "path", "config", "fine", "finer", "finest", "d", "dbg", "vrb", "verbose")
INFO_WORDS = ("info", "informational", "notice", "ok", "low", "p4", "resolved", "plain", "i", "inf", "information", "audit_success", "unknown", "success")
WARN_WORDS = ("warn", "warning", "medium", "p3", "minor", "w", "wrn", "audit_failure")
ERROR_WORDS = ("error", "err", "high", "p2", "firing", "major", "e", "failed", "failure")
CRITICAL_WORDS = ("critical", "crit", "fatal", "alert", "emerg", "emergency", "severe", "p1", "f", "ftl", "panic")
# Level words in a line, and phrases that hint at a severity.
LEVEL_WORD = r"(?i)(?<![A-Za-z])(TRACE|DEBUG|INFO|NOTICE|WARN(?:ING)?|ERR(?:OR)?|CRIT(?:ICAL)?|FATAL|ALERT|EMERG(?:ENCY)?|SEVERE|PANIC|INF|WRN|FTL|DBG|VRB)(?![A-Za-z])"
ERROR_HINT = r"(?i)(ORA-\d{5}|APP-FND-\d{5}|FRM-\d{5}|TNS-\d{5}|Traceback \(most recent call last\)|\b[A-Za-z_.$]*(?:Exception|Error)\b: |deadlock detected|Out of memory|\bsegfault\b|\bpanic:|\bkernel panic|\bStack overflow\b|\bBACKUP failed\b|\bLogin failed\b|\bAssertion failure\b|\bcircuit breaker open\b)"
WARN_HINT = r"(?i)(\btimed out\b|\btimeout\b|\bretry\b|\bretrying\b|\bdeferred\b|\bdenied\b|\brefused\b|\bslow query\b|\bunreachable\b|\bdegraded\b|\bdeprecated\b)"
# Names of each environment, and which of them count inside other words' neighbourhood.
PROD_NAMES = ("prod", "production", "prd", "live", "canli", "uretim")
TEST_NAMES = ("test", "tst", "testing")
QA_NAMES = ("qa",)
UAT_NAMES = ("uat", "acceptance", "kabul")
DEV_NAMES = ("dev", "development", "develop", "gelistirme", "local", "sandbox")
STAGING_NAMES = ("staging", "stage", "stg", "preprod", "pre-prod", "canary")
DR_NAMES = ("dr", "disaster")
ENVIRONMENT_TOKEN = r"(?i)(?<![a-z0-9])(prod|production|prd|test|tst|qa|uat|dev|development|staging|stage|stg|preprod|canary|sandbox|live)(?![a-z0-9])"
# Personal data and secrets.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
IBAN = r"\bTR\d{2}(?:\s?\d{4}){5}\s?\d{2}\b|\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"
PHONE = r"(?<![\w])(?:\+?90[\s\-]?)?\(?0?5\d{2}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}(?![\w])"
SECRET = r"(?i)\b(password|passwd|pwd|parola|sifre|şifre|token|secret|api[_-]?key|authorization)\b(\s*[=:]\s*|\"\s*:\s*\")(Bearer\s+)?[^\s&\",;]+"
BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._\-~+/]{12,}=*"
SEGMENT_ID = r"^(?:\d+|[0-9a-fA-F]{8}-[0-9a-fA-F\-]{27,}|[0-9a-fA-F]{12,}|[A-Za-z0-9_\-]{20,}|.*@.*|[A-Z]{2}\d{2}[A-Z0-9]{10,})$"
NO_NAME = ("", "-", "anonymous", "null", "none")


def rank(severity: Column) -> Column:
    """0 (DEBUG) to 4 (CRITICAL); null for anything else."""
    pos = F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)
    return F.when(pos > 0, (pos - 1).cast("int"))


def fold(text: Column) -> Column:
    """Case folding that maps Turkish letters to their ASCII base; null becomes empty."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "ıİIşŞğĞüÜöÖçÇ", "iiissgguuoocc"))


def glob(text: Column, pattern: str) -> Column:
    """Whole-value match of a folded glob: `*` any run, `?` one character; a missing value never matches."""
    import re

    folded = pattern.translate(str.maketrans("ıİIşŞğĞüÜöÖçÇ", "iiissgguuoocc")).lower()
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", folded))
    return F.coalesce(fold(text).rlike(f"(?s)^{body}$") & text.isNotNull(), F.lit(False))


def present(text: Column) -> Column:
    """Neither null, empty nor a dash."""
    return F.coalesce(~text.isin("", "-"), F.lit(False))


def number(text: Column) -> Column:
    """Decimal number with a point or comma; null for anything else."""
    return F.when(text.rlike(r"^-?\d+([.,]\d+)?$"), F.replace(text, F.lit(","), F.lit(".")).try_cast("double"))


def compare(text: Column, op: str, value: float) -> Column:
    """Numeric comparison that is false for a missing or non-numeric value."""
    n = number(text)
    test = {">": n > value, ">=": n >= value, "<": n < value, "<=": n <= value, "=": n == value}[op]
    return F.coalesce(test, F.lit(False))


def template(message: Column) -> Column:
    """Message with its variable parts masked in one pass, leftmost match first, then white space, case and length normalised."""
    text = F.trim(message)
    # Where none of these begins, none of the masks does, so most places are passed over at once.
    pattern = r"(?i)(?=[\d/]|https?:|[0-9a-f]{8})(?:" + "|".join(m for m, _ in MASKS) + ")"

    def mask(x: Column) -> Column:
        out = F.lit("<n>")
        for pattern, name in reversed(MASKS[:7]):
            name_col = F.concat(F.lit("<n>"), F.regexp_extract(x, r"([A-Za-z%]+)$", 1)) if pattern is MASKS[6][0] else F.lit(name)
            out = F.when(x.rlike("(?i)^(?:" + pattern.replace(r"(?<=[\s=:/])", "") + ")$"), name_col).otherwise(out)
        # Most hits are short numbers, which are none of the others.
        return F.when(x.rlike(r"^\d{1,15}\z"), "<n>").otherwise(out)

    # One search puts a character around the hits that the text doesn't have; `split` would compile any longer pattern anew for each row.
    mark = "\u0000"
    around = F.split(F.regexp_replace(text, pattern, mark + "$0" + mark), mark, -1)
    marked = F.transform(around, lambda x, i: F.when(i % 2 == 1, mask(x)).otherwise(x))
    hits = F.regexp_extract_all(text, F.lit(pattern), 0)
    apart = F.zip_with(F.split(text, pattern, -1), F.transform(hits, mask), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    pieces = F.when(F.contains(text, F.lit(mark)), apart).otherwise(marked)
    # Numbers and quantities alone need no list of pieces, whose functions aren't compiled. A quantity keeps its unit, but not a per cent sign.
    numbers = F.regexp_replace(text, r"(?i)(?=\d)\b(?:\d+(?:\.\d+)?\s?(?:(ms|s|sec|m|h|kb|mb|gb)|%)\b|\d+\b)", "<n>$1")
    masked = F.when(text.rlike(LONG_MASKS), F.regexp_replace(F.array_join(pieces, ""), r"\s+", " ")).otherwise(numbers)
    return F.substring(F.lower(masked), 1, 200)


def fingerprint(templ: Column, severity: Column, service: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", templ, severity, F.lower(service))), 1, 12)


def group_key(templ: Column, service: Column) -> Column:
    named = F.when(present(service), service).otherwise("-")
    return F.substring(F.sha1(F.concat(templ, F.char(F.lit(0)), named)), 1, 12)


def pool(host: Column) -> Column:
    """Host name without domain and trailing number; a dash for addresses and missing names."""
    short = F.lower(F.substring_index(host, ".", 1))
    stem = F.regexp_extract(short, r"^(.*?)[-_.]?\d+[a-z]?$", 1)
    return F.when(~present(host) | host.rlike(r"^[\d.:]+$"), "-").otherwise(F.when(stem != "", stem).otherwise(short))


def latency_ms(message: Column) -> Column:
    """First `<n> ms` of a message; null without one."""
    return F.nullif(F.regexp_extract(message, r"(\d+(?:\.\d+)?)\s?ms\b", 1), F.lit("")).cast("double")


def severity_of(word: Column) -> Column:
    """Severity for a level word; syslog digits 0 to 4 are the urgent ones; INFO for anything else."""
    w = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    out = F.when(w.isin("0", "1", "2"), "CRITICAL").when(w == "3", "ERROR").when(w == "4", "WARN")
    for severity, words in zip(SEVERITIES, (DEBUG_WORDS, INFO_WORDS, WARN_WORDS, ERROR_WORDS, CRITICAL_WORDS), strict=True):
        out = out.when(w.isin(*words), severity)
    return out.otherwise("INFO")


def severity_from_text(text: Column) -> Column:
    """The level word of a line, else what its phrases hint at, else INFO."""
    word = F.regexp_extract(text, LEVEL_WORD, 1)
    return F.when(word != "", severity_of(word)).when(text.rlike(ERROR_HINT), "ERROR").when(text.rlike(WARN_HINT), "WARN").otherwise("INFO")


def _environment(name: Column) -> Column:
    """The environment that a lower-cased name stands for; null for another."""
    groups = {"prod": PROD_NAMES, "test": TEST_NAMES, "qa": QA_NAMES, "uat": UAT_NAMES, "dev": DEV_NAMES, "staging": STAGING_NAMES, "dr": DR_NAMES}
    out = F.lit(None).cast("string")
    for environment, names in groups.items():
        out = F.when(name.isin(*names), environment).otherwise(out)
    return out


def normal_environment(value: Column) -> Column:
    """`Production`, `PRD`, `prod-eu` as `prod`; another value lower-cased, 20 characters at most; empty for none."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    inside = F.lower(F.regexp_extract(v, ENVIRONMENT_TOKEN, 1))
    return F.coalesce(_environment(v), _environment(inside), F.substring(v, 1, 20))


def environment_of(*texts: Column) -> Column:
    """Environment named by the first text that holds such a token; empty without one."""
    found = F.coalesce(*[F.nullif(F.lower(F.regexp_extract(t, ENVIRONMENT_TOKEN, 1)), F.lit("")) for t in texts])
    return F.coalesce(_environment(found), F.lit(""))


def path_template(url: Column, segments: int = 8) -> Column:
    """Path of a URL with identifiers as {id}, without origin, query and fragment."""
    bare = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*", 0)
    path = F.when(bare.rlike("://"), F.concat(F.lit("/"), F.regexp_extract(bare, r"^.*?://[^/]*/(.*)$", 1))).otherwise(bare)
    parts = F.transform(F.split(path, "/", -1), lambda s: F.when(s.rlike(SEGMENT_ID) | s.rlike(r"\d{4,}"), "{id}").otherwise(s))
    out = F.array_join(F.slice(parts, 1, segments + 1), "/")
    return F.when(bare == "", "").when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def scrub(text: Column) -> Column:
    """Secrets, mail addresses, account numbers, phone numbers and card numbers replaced by marks."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), SECRET, "$1$2***")
    for pattern, mark in ((BEARER, "Bearer ***"), (EMAIL, "[E-POSTA]"), (IBAN, "[IBAN]"), (PHONE, "[TEL]")):
        t = F.regexp_replace(t, pattern, mark)

    def card(x: Column) -> Column:
        d = F.regexp_replace(x, r"\D", "")
        return F.when((F.length(d) == 11) & _citizen(d), "[TCKN]").when(F.length(d).between(13, 19) & F.call_function("luhn_check", d), "[KART]").otherwise(x)

    t = _replaced(t, r"(?<![\w])\d[\d \-]{9,22}\d(?![\w])", card)
    # Also beside letters.
    return _replaced(t, r"(?<!\d)\d{11}(?!\d)", lambda x: F.when(_citizen(x), "[TCKN]").otherwise(x))


def _replaced(text: Column, pattern: str, made: Callable[[Column], Column]) -> Column:
    """Each match of a pattern replaced by what `made` gives for it."""
    kept, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(kept, F.transform(hits, made), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _citizen(d: Column) -> Column:
    """Checksum of an 11-digit identity number."""
    n = [F.substring(d, i + 1, 1).try_cast("int") for i in range(11)]
    odd, even = n[0] + n[2] + n[4] + n[6] + n[8], n[1] + n[3] + n[5] + n[7]
    return F.coalesce((n[0] != 0) & (F.pmod(odd * 7 - even, F.lit(10)) == n[9]) & (F.pmod(odd + even + n[9], F.lit(10)) == n[10]), F.lit(False))


def pseudonym(value: Column, key: bytes, prefix: str = "u") -> Column:
    """Keyed hash (HMAC-SHA256) of a trimmed lower-cased name, 16 hex digits after the prefix; empty for no name."""
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    first = F.unhex(F.sha2(F.concat(F.lit(inner), F.encode(v, "utf-8")), 256))
    return F.when(v.isin(*NO_NAME), "").otherwise(F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat(F.lit(outer), first), 256), 1, 16)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


# What a variable token looks like.
VARIABLE = r"^(?:\d+(?:[.,]\d+)?[%a-zA-Z]{0,3}|0x[0-9a-fA-F]+|[0-9a-fA-F]{8,}|[0-9a-f-]{36}|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?|\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?[\w.:+-]*)?|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?|/[\w./-]{3,}|https?://\S+|[\w.+-]+@[\w.-]+)[,;:)]?$"


def drain_tokens(message: Column) -> Column:
    """A message's tokens without punctuation around them; values and variable tokens as `<*>`."""
    bare = F.transform(F.split(F.trim(message), r"\s+"), lambda t: F.regexp_replace(t, r"""^[,;:()\[\]{}"']+|[,;:()\[\]{}"']+$""", ""))
    named = lambda t: F.when(t.contains("=") & ~t.startswith("="), F.concat(F.substring_index(t, "=", 1), F.lit("=<*>"))).when(t.rlike(VARIABLE), "<*>").otherwise(t)
    return F.transform(F.filter(bare, lambda t: t != ""), named)


# Well-known ports, and the kind of thing behind each protocol.
PORTS = {
    22: "ssh", 25: "smtp", 53: "dns", 80: "http", 88: "kerberos", 110: "pop3", 123: "ntp", 143: "imap", 389: "ldap", 443: "https", 445: "smb", 465: "smtps", 587: "smtp", 636: "ldaps", 1433: "sqlserver", 1521: "oracle", 1522: "oracle", 2049: "nfs", 2181: "zookeeper",
    3200: "sap-dialog", 3201: "sap-dialog", 3300: "sap-rfc", 3301: "sap-rfc", 3306: "mysql", 3389: "rdp", 3600: "sap-ms", 4222: "nats", 5000: "http", 5432: "postgres", 5601: "kibana", 5672: "amqp", 6379: "redis", 6443: "kubernetes", 7001: "weblogic", 8000: "http", 8080: "http", 8443: "https",
    9000: "http", 9042: "cassandra", 9092: "kafka", 9200: "elasticsearch", 9300: "elasticsearch", 11211: "memcached", 15672: "rabbitmq", 27017: "mongodb", 30015: "hana", 30013: "hana", 30041: "hana", 50000: "sap-http", 50001: "sap-https", 1414: "ibm-mq", 0: "jdbc",
}
CATEGORIES = {
    "db": ("jdbc", "postgres", "oracle", "mysql", "sqlserver", "hana", "mongodb", "cassandra"), "cache": ("redis", "memcached"), "messaging": ("kafka", "amqp", "rabbitmq", "ibm-mq", "nats", "zookeeper"), "api": ("http", "https", "weblogic"),
    "sap": ("sap-http", "sap-https", "sap-dialog", "sap-rfc", "sap-ms"), "identity": ("ldap", "ldaps", "kerberos"), "mail": ("smtp", "smtps", "imap", "pop3"), "file": ("ssh", "smb", "nfs"), "observability": ("elasticsearch", "kibana"), "infra": ("dns", "ntp", "kubernetes"), "remote": ("rdp",),
}


def protocol(port: Column) -> Column:
    """Name of the protocol behind a port; `tcp/<port>` for one that isn't known."""
    known = F.create_map(*[x for k, v in PORTS.items() for x in (F.lit(k), F.lit(v))])
    hana = port.between(30_000, 39_999) & (port % 100 == 15)
    return F.coalesce(known[port], F.when(hana, "hana"), F.concat(F.lit("tcp/"), port))


def protocol_category(name: Column) -> Column:
    out = F.lit("other")
    for category, names in CATEGORIES.items():
        out = F.when(name.isin(*names), category).otherwise(out)
    return out


def severity_mask(severity: Column) -> Column:
    """One bit for each severity, DEBUG the lowest; nothing for anything else."""
    return F.coalesce(F.call_function("shiftleft", F.lit(1), rank(severity)), F.lit(0))


def dig(document: Column, path: str) -> Column:
    """The value at a path such as `data.items[0].rows` of a JSON text."""
    return F.get_json_object(document, f"$.{path}")


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as version `a` is before, the same as or after `b`; parts compare as numbers, missing ones as 0."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+", 0).try_cast("bigint"), F.lit(0)))
    signs = F.zip_with(parts(a), parts(b), lambda x, y: F.signum(F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))).cast("int"))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0))


def agent_family(agent: Column) -> Column:
    """(os, browser) of a user agent; empty for what isn't known."""
    has = lambda p: F.coalesce(agent.rlike(p), F.lit(False))
    os = F.when(has("Android"), "Android").when(has("iPhone|iPad|iOS"), "iOS").when(has("Windows"), "Windows").when(has("Mac OS X"), "macOS").when(has("Linux"), "Linux").otherwise("")
    browser = F.when(has("Edg/"), "Edge").when(has("Chrome/"), "Chrome").when(has("Firefox/"), "Firefox").when(has("Safari/"), "Safari").otherwise("")
    return F.struct(os.alias("os"), browser.alias("browser"))


# What a query may call each level.
LEVEL_ALIASES = {
    "CRITICAL": ("crit", "critical", "fatal", "emerg", "emergency", "alert", "panic", "kritik"), "ERROR": ("err", "error", "hata"), "WARN": ("warn", "warning", "uyari"),
    "INFO": ("info", "information", "notice", "ok", "success", "bilgi"), "DEBUG": ("debug", "trace", "verbose"),
}


def level_is(severity: Column, name: str, op: str = "=") -> Column:
    """Level predicate by any of a level's names, also as a glob over them; `>=` takes all levels from the named one up."""
    from fnmatch import fnmatchcase

    named = [level for level, aliases in LEVEL_ALIASES.items() if any(fnmatchcase(a, name.lower()) for a in (*aliases, level.lower()))]
    least = min((SEVERITIES.index(level) for level in named), default=len(SEVERITIES))
    wanted = [level for level in SEVERITIES if (SEVERITIES.index(level) >= least if op == ">=" else level in named)]
    return F.coalesce(severity.isin(*wanted), F.lit(False)) if wanted else F.lit(False)


def holds(text: Column, term: str) -> Column:
    """Substring match of a folded term; a `*` in it stands for characters that aren't white space, a `?` for one of them."""
    import re

    folded = term.translate(str.maketrans("ıİIşŞğĞüÜöÖçÇ", "iiissgguuoocc")).lower()
    body = "".join(r"\S*" if c == "*" else r"\S" if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", folded))
    return fold(text).rlike(body)


def attribute(attributes: Column, key: str) -> Column:
    """An attribute by its exact key, else by the key in any case of letters (the first by name)."""
    others = F.array_sort(F.filter(F.map_entries(attributes), lambda e: F.lower(e["key"]) == key.lower()))
    return F.coalesce(attributes[key], F.get(others, F.lit(0))["value"])


def entropy(token: Column) -> Column:
    """Shannon entropy of a token's characters in bits; 0 for an empty one."""
    c = F.filter(F.split(token, ""), lambda x: x != "")
    n = F.size(c)
    share = lambda x: F.size(F.filter(c, lambda y: y == x)) / n
    return F.aggregate(F.array_distinct(c), F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x)))


def chunks(document: Column, size: int = 900) -> Column:
    """Paragraphs packed to chunks of about `size` characters; a longer paragraph is a chunk alone."""
    parts = F.filter(F.transform(F.split(document, r"\n\s*\n|\n(?=#+ )"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")

    def add(s: Column, p: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(p) + 2 > size)
        joined = F.when(s["open"] == "", p).otherwise(F.concat(s["open"], F.lit("\n\n"), p))
        return F.struct(F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"), F.when(full, p).otherwise(joined).alias("open"))

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")), add, end)


def first_keys(entries: Column) -> Column:
    """A map of (key, value) entries; of equal keys the first counts, null keys are left out."""
    add = lambda m, e: F.map_concat(m, F.map_from_arrays(F.array(e["key"]), F.array(e["value"])))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda m, e: F.when(e["key"].isNull() | F.map_contains_key(m, F.coalesce(e["key"], F.lit(""))), m).otherwise(add(m, e)))


def flatten_json(document: Column, depth: int = 3) -> Column:
    """Leaves of a JSON object as a map from dotted keys to texts; deeper objects stay texts.

    Of keys that come out equal the first counts; a text that only looks like an
    object stays a text. Null for what isn't a JSON object.
    """
    level = F.map_entries(F.from_json(document, "map<string,string>"))
    inner = lambda e: F.transform(F.map_entries(F.from_json(e["value"], "map<string,string>")), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))
    for _ in range(depth - 1):
        level = F.flatten(F.transform(level, lambda e: F.when(e["value"].startswith("{"), F.coalesce(inner(e), F.array(e))).otherwise(F.array(e))))
    return F.when(level.isNotNull(), first_keys(level))


def identity(attributes: Column, key: bytes) -> Column:
    """Whose session a line belongs to: the session's name, else the user with the client, else the client; pseudonyms, empty for nobody."""
    first = lambda *names: F.coalesce(*[F.when(present(attribute(attributes, n)), attribute(attributes, n)) for n in names])
    session, user, client = first("rum_session", "session_id", "sid", "jsessionid"), first("user_id", "user", "username"), first("client_ip", "client", "remote_addr")
    return pseudonym(F.coalesce(session, F.concat_ws("@", user, client)), key, "s")
