"""Scalar functions over text columns, all of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of the search tokenizer.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could to of in "
    "for on with at by from as into through and but or not if then that this it its self"
).split()

#: The redaction's known prefixes.
KNOWN_PREFIXES = ["AKIA", "sk_live_", "sk_test_", "ghp_", "gho_", "github_pat_", "eyJ", "xoxb-", "xoxp-", "Bearer "]

#: Patterns of text that should not be published, with their severity.
CONTENT_PATTERNS = {
    "private_key": ("critical", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    "aws_key": ("high", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    "github_token": ("high", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    "jwt": ("high", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    "email": ("medium", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    "ipv4": ("low", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
}

#: Secret detectors (severity, pattern with the secret as its group).
SECRET_RULES = {
    "aws_access_key": ("CRITICAL", r"\b(AKIA[0-9A-Z]{16})\b"),
    "aws_secret_key": ("CRITICAL", r"(?i)(?:aws_secret(?:_access)?_key|aws[_-]key)\s*[:=]\s*['\"]?([A-Za-z0-9/+=]{40})['\"]?"),
    "private_key": ("CRITICAL", r"(-----BEGIN (?:RSA |EC |OPENSSH |PGP |DSA )?PRIVATE KEY-----[\s\S]+?-----END (?:RSA |EC |OPENSSH |PGP |DSA )?PRIVATE KEY-----)"),
    "stripe_api_key": ("HIGH", r"\b(sk_live_[0-9a-zA-Z]{16,56})\b"),
    "stripe_test_key": ("MEDIUM", r"\b(sk_test_[0-9a-zA-Z]{16,56})\b"),
    "github_pat": ("HIGH", r"\b(ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82})\b"),
    "jwt_token": ("MEDIUM", r"\b(eyJ[A-Za-z0-9_-]{4,}\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,})\b"),
    "slack_token": ("HIGH", r"\b(xox[bpas]-[0-9A-Za-z\-]{10,})\b"),
    "db_connection_string": ("HIGH", r"(?i)\b((?:postgres|postgresql|mysql|mongodb(?:\+srv)?|redis)://[^\s\"'<>:]+:[^\s\"'<>@]{3,}@[^\s\"'<>]+)\b"),
    "env_secret": ("HIGH", r"(?m)^[ \t]*(?:AWS_SECRET_ACCESS_KEY|SECRET_KEY|API_KEY|PRIVATE_KEY|AUTH_TOKEN|DATABASE_URL|DB_PASSWORD)\s*=\s*([\"']?.{8,}?[\"']?)[ \t]*$"),
    "hardcoded_password": ("HIGH", r"(?i)(?:password|passwd|pwd)\s*[:=]\s*['\"]([^'\"]{8,})['\"](?!\w)"),
}
TOKEN_RUN = r"[A-Za-z0-9_\-+/=]{20,}"


def log_pattern(message: Column) -> Column:
    """Lower case, whole-word numbers and then long hexadecimal words folded, trimmed."""
    numbers = F.regexp_replace(F.lower(message), r"\b\d+\b", "<number>")
    return F.trim(F.regexp_replace(numbers, r"\b[a-f0-9]{8,}\b", "<id>"))


def spaced(text: Column) -> Column:
    """Lower case, with a blank where a lower letter is followed by an upper one."""
    return F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))


def all_tokens(text: Column) -> Column:
    """Runs of letters or digits, split at lower-to-upper changes; short ones, empty ones and stop words are still there."""
    return F.split(spaced(text), "[^a-z0-9]+")


def search_tokens(text: Column) -> Column:
    """Words of two or more letters or digits, split at lower-to-upper changes, without stop words."""
    return F.filter(all_tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def skeleton(name: Column) -> Column:
    """Names that look alike have one skeleton: rn is m, vv is w, separators go, look-alike digits become letters."""
    low = F.replace(F.replace(F.lower(name), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(F.regexp_replace(low, "[-_.]", ""), "01|53", "ollse")


def package_name(name: Column) -> Column:
    """Runs of - _ . are one hyphen; lower case."""
    return F.regexp_replace(F.lower(name), "[-_.]+", "-")


def name_scope(name: Column) -> Column:
    """The scope of @scope/name, null without one."""
    found = F.regexp_extract(name, "^@([^/]+)/(.+)$", 1)
    return F.when(found != "", found)


def bare_name(name: Column) -> Column:
    return F.regexp_replace(name, "^@[^/]+/", "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(text, "")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(-F.aggregate(parts, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


#: How many first characters of a secret without a known prefix are shown, by the most characters that it may have.
SHOWN = {4: 0, 8: 2}
SHOWN_OF_LONGER = 4


def masked(secret: Column, shown: int) -> Column:
    return F.concat(F.substring(secret, 1, shown), F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(secret) - shown)))


def redacted(secret: Column) -> Column:
    """A known prefix and four stars or more, else the first few characters and stars."""
    n = F.length(secret)
    prefix = F.coalesce(*(F.when(secret.startswith(p) & (n > len(p) + 1), F.lit(p)) for p in KNOWN_PREFIXES))
    by_length = F.coalesce(*(F.when(n <= most, masked(secret, shown)) for most, shown in SHOWN.items()), masked(secret, SHOWN_OF_LONGER))
    return F.when(n == 0, F.lit("[REDACTED]")).when(prefix.isNotNull(), F.concat(prefix, F.repeat(F.lit("*"), F.greatest(F.lit(4), n - F.length(prefix))))).otherwise(by_length)


def looks_binary(text: Column) -> Column:
    """Over a tenth of the first 512 characters are control characters."""
    sample = F.substring(text, 1, 512)
    controls = F.length(sample) - F.length(F.regexp_replace(sample, "[\\x00-\\x08\\x0E-\\x1F]", ""))
    return controls / F.length(sample) > 0.1


def byte_size(text: Column) -> Column:
    """'10', '1.5 kB', '2MiB' as bytes; decimal and binary suffixes, null if it is neither."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 1), F.lower(F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*$", 2))
    scale = F.when(unit.isin("", "b"), F.lit(1))
    for k, letter in enumerate("kmgt", 1):
        scale = scale.when(unit.isin(letter, f"{letter}b"), F.lit(1000**k)).when(unit.isin(f"{letter}i", f"{letter}ib"), F.lit(1024**k))
    return F.when(number != "", (number.cast("double") * scale).cast("long"))


def duration_seconds(text: Column) -> Column:
    """'90', '90s', '5m', '2h', '1d' as seconds; null if it is none of these."""
    number, unit = F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*$", 1), F.regexp_extract(text, r"^\s*(\d+(?:\.\d+)?)\s*([smhd]?)\s*$", 2)
    scale = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(number != "", number.cast("double") * scale)


#: Pools of characters, the last being all others, and how many each has.
POOLS = {"[A-Z]": 26, "[a-z]": 26, "[0-9]": 10, "[^A-Za-z0-9]": len("!@#$%^&*()_+-=[]{}|;:,.<>?")}
#: Points for a length, by the least length.
LENGTH_POINTS = {24: 20, 16: 10, 12: 0, 8: -15, 0: -30}
#: Parts that make a password easy to guess, and what any of them costs.
COMMON_PARTS = ["12345", "qwerty", "asdfgh", "password", "admin", "letmein", "welcome", "monkey", "abc123", "iloveyou", "dragon"]
COMMON_COST = 20
#: Points a bit of entropy; what each missing pool costs below so many pools and characters; each run of three and more, and all of them at most;
#: and a share of distinct characters under which a password of so many characters loses points.
POINTS_A_BIT = 1.25
FEW_POOLS, LONG_ENOUGH, POOL_COST = 3, 20, 10
RUN_COST, RUNS_COST = 10, 20
FEW_DISTINCT, DISTINCT_FROM, DISTINCT_COST = 0.5, 8, 15
#: Tiers by their least score.
TIERS = {90: "EXCELLENT", 80: "STRONG", 60: "MODERATE", 40: "WEAK", 0: "CRITICAL"}


def banded(value: Column, bands: dict) -> Column:
    """What the first band gives whose bound the value reaches; the bounds fall."""
    return F.coalesce(*(F.when(value >= least, F.lit(given)) for least, given in bands.items()))


def password_score(password: Column) -> Column:
    """0 to 100: the points of its pool entropy and length, less what few pools, common parts, runs and few distinct characters cost."""
    n = F.length(password)
    pools = [(password.rlike(pattern).cast("int"), size) for pattern, size in POOLS.items()]
    used = sum((has for has, _ in pools), F.lit(0))
    pool = F.greatest(F.lit(1), sum((has * size for has, size in pools), F.lit(0)))
    bits = F.round(n * F.log2(pool.cast("double")), 2)
    terms = [
        F.least(F.lit(100), F.floor(bits * POINTS_A_BIT + 0.5)),
        banded(n, LENGTH_POINTS),
        F.when((used < FEW_POOLS) & (n < LONG_ENOUGH), (used - len(POOLS)) * POOL_COST),
        F.when(F.lower(password).rlike("|".join(COMMON_PARTS)), F.lit(-COMMON_COST)),
        -F.least(F.lit(RUNS_COST), F.regexp_count(password, F.lit(r"(.)\1{2,}")) * RUN_COST),
        F.when((F.size(F.array_distinct(F.split(password, ""))) < n * FEW_DISTINCT) & (n >= DISTINCT_FROM), F.lit(-DISTINCT_COST)),
    ]
    total = sum((F.coalesce(term, F.lit(0)) for term in terms), F.lit(0))
    return F.when(password.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), total))).cast("int")


def password_tier(score: Column) -> Column:
    return banded(score, TIERS)


def human_size(size: Column) -> Column:
    """1536 as '1.5 KiB'; whole bytes below 1024, TiB for all that is larger."""
    units = ["KiB", "MiB", "GiB", "TiB"]
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        out = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", size / 1024**k)).otherwise(out)
    return out


def unsafe_archive_name(name: Column) -> Column:
    """Empty, with a NUL, absolute, with a drive, or with a .. part."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return (path == "") | path.contains("\x00") | path.rlike(r"^(?:/|[A-Za-z]:)") | path.rlike(r"(?:^|/)\.\.(?:/|$)")


def places(text: Column, pattern: str) -> Column:
    """Array of (start from 0, text) of a pattern's matches, from what lies between them. The pattern must not match the empty string."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    length = lambda parts, upto: F.aggregate(F.slice(parts, F.lit(1), upto), F.lit(0), lambda n, x: n + F.length(x))
    each = F.transform(found, lambda x, k: F.struct((length(between, k + 1) + length(found, k)).alias("start"), x.alias("text")))
    return F.when(F.size(found) > 0, each).otherwise(F.array().cast("array<struct<start: int, text: string>>"))


def line_of(text: Column, start: Column) -> Column:
    """The line, from 1, of a place (from 0)."""
    before = F.substr(text, F.lit(1), start)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: Column, start: Column) -> Column:
    """The column, from 1, of a place (from 0)."""
    return F.length(F.element_at(F.split(F.substr(text, F.lit(1), start), "\n", -1), -1)) + 1


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as an array of numbers."""
    h = F.hex(data)
    return F.when(F.octet_length(data) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda k: F.conv(F.substr(h, 2 * k - 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


#: The reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def crc32c(data: Column) -> Column:
    """CRC-32C of a binary column, by a table of 256 steps."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (CASTAGNOLI if byte & 1 else 0)
        table.append(byte)
    steps = F.array(*(F.lit(x).cast("long") for x in table))
    last = F.aggregate(byte_values(data), F.lit(0xFFFFFFFF).cast("long"), lambda c, b: F.shiftright(c, 8).bitwiseXOR(F.element_at(steps, (c.bitwiseXOR(b).bitwiseAND(F.lit(255)) + 1).cast("int"))))
    return last.bitwiseXOR(F.lit(0xFFFFFFFF).cast("long"))


def hmac(data: Column, key: bytes, kind: str = "sha256") -> Column:
    """The lower-case hexadecimal HMAC of a binary column under one key, by the built-in digests."""
    import hashlib

    digest = (lambda c: F.sha2(c, 256)) if kind == "sha256" else F.sha1
    short = key if len(key) <= 64 else hashlib.new(kind, key).digest()
    inner, outer = (F.lit(bytearray(b ^ pad for b in short.ljust(64, b"\0"))) for pad in (0x36, 0x5C))
    return digest(F.concat(outer, F.unhex(digest(F.concat(inner, data)))))


def hotp(counter: Column, key: bytes, digits: int = 6) -> Column:
    """One-time passwords of a key (RFC 4226)."""
    mac = hmac(F.unhex(F.lpad(F.hex(counter), 16, "0")), key, "sha1")
    at = F.conv(F.substring(mac, 40, 1), 16, 10).cast("int") * 2 + 1
    return F.lpad((F.conv(F.substr(mac, at, F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF)) % 10**digits).cast("string"), digits, "0")


def totp(seconds: Column, key: bytes, digits: int = 6, period: int = 30) -> Column:
    return hotp(F.floor(seconds / period), key, digits)


def base32_key(text: str) -> bytes:
    """The bytes of a base32 secret; blanks and hyphens are skipped, padding may be left out."""
    import base64

    plain = text.replace(" ", "").replace("-", "").rstrip("=").upper()
    return base64.b32decode(plain + "=" * (-len(plain) % 8))
