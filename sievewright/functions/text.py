"""Text functions as Column -> Column, on Spark SQL built-ins only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a character class: white space of any script, as both regular-expression dialects write it.
BLANK = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: The same as a string of characters.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# --- fixed values: prefixes, quote markers, footers and phrases that results depend on ---
SUBJECT_PREFIXES = rf"(?i)^(?:re\[[0-9]+\][{BLANK}:_]+|re[{BLANK}:_]+|回复[{BLANK}:_]+|转发[{BLANK}:_]+|fwd[{BLANK}:_]+|【外部邮件】[{BLANK}]*|\[re\][{BLANK}]*)+"
QUOTE_LINE = r"^>+|^\||(?i:^On .+ wrote:)|^---|^在 .+写道:|^发件人|^_{2,}"
CREDENTIAL = rf"(?i)\b(api[_-]?key|token|password|secret)[{BLANK}]*[:=][{BLANK}]*[^{BLANK},;]+"
ATTACHED = rf"(?i)\b(?:see|please find)[{BLANK}]+(?:the[{BLANK}]+)?attached\b"
HTML_START = rf"(?i)^[{BLANK}]*<(?:html|!doctype)"
INJECTIONS = ("ignore previous instructions", "ignore all previous instructions", "忽略之前指令", "忽略前面的指令", "忽略先前指令")
NO_CODE = ("-", "*", "none", "n/a", "null")
# --- end of fixed values ---

NBSP = "\u00a0"


@dataclass(frozen=True)
class CleaningPolicy:
    """How a message becomes retrieval text; limits count characters."""

    version: str = "generic-v1"
    latest_max_chars: int = 1800
    context_max_chars: int = 1200
    attachments_max_chars: int = 300
    min_meaningful_chars: int = 10
    signature_delimiters: tuple[str, ...] = ("-- ", "Kind regards", "Best regards", "Regards", "谢谢", "此致")
    disclaimer_patterns: tuple[str, ...] = (r"This email (?:and any attachments )?may contain confidential information.*",)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is worked out once a row, however often it is used: no optimizer rule moves it through the generator."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once: inside lambdas and branches Spark would repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(x, F.lit(BLANKS))


def fold_whitespace(x: Column) -> Column:
    """Runs of white space, no-break spaces too, as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"[{BLANK}]+", " "))


def clean_subject(x: Column) -> Column:
    """The subject without reply and forward prefixes, however many."""
    return fold_whitespace(F.regexp_replace(F.translate(x, NBSP, " "), SUBJECT_PREFIXES, ""))


def email_address(sender: Column) -> Column:
    """What stands in angle brackets, else the whole."""
    return F.when(sender.rlike("<[^>]*>"), F.regexp_extract(sender, "<([^>]*)>", 1)).otherwise(sender)


def sender_domain(sender: Column) -> Column:
    return domain_of(email_address(sender))


def local_part(sender: Column) -> Column:
    return local_of(email_address(sender))


def domain_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.lower(F.trim(F.substring_index(address, "@", -1)))).otherwise("")


def local_of(address: Column) -> Column:
    return F.when(address.contains("@"), F.trim(F.regexp_extract(address, "(?s)^(.*)@[^@]*$", 1))).otherwise("")


def gateway_domain(address: Column) -> Column:
    """After the last @, lowered; a closing bracket stays."""
    return F.lower(F.substring_index(address, "@", -1))


def split_trimmed(x: Column, separator: str) -> Column:
    """Parts between separators, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(x, separator), strip), lambda p: p != "")


def is_html(body: Column) -> Column:
    return body.rlike(HTML_START)


def has_injection(body: Column) -> Column:
    low = F.lower(body)
    found = F.lit(False)
    for phrase in INJECTIONS:
        found = found | low.contains(phrase)
    return found


# --- threads ---


def lines_of(x: Column) -> Column:
    return F.split(x, "\n")


def quote_starts(lines: Column) -> Column:
    """Positions (from 0) of lines that begin a run of quoted lines."""
    quoted = F.transform(lines, lambda line: line.rlike(QUOTE_LINE))
    before = lambda q: F.concat(F.array(F.lit(False)), F.slice(q, 1, F.size(q) - 1))
    starts = let(quoted, lambda q: F.zip_with(q, before(q), lambda now, prior: now & ~prior))
    return F.filter(F.transform(starts, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())


def _unquoted(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(line, rf"^>+[{BLANK}]*", ""), rf"^\|+[{BLANK}]*", "")


def _quoted_parts(lines: Column, starts: Column) -> Column:
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
    return F.zip_with(starts, ends, lambda s, e: strip(F.array_join(F.transform(F.slice(lines, s + 1, e - s), _unquoted), "\n")))


def thread_segments(body: Column) -> Column:
    """struct(parsed, segments): the latest text, then each quoted run up to the next, newest first."""

    def split(lines: Column, starts: Column) -> Column:
        latest = strip(F.array_join(F.slice(lines, 1, F.get(starts, F.lit(0))), "\n"))
        plain = is_html(body) | (F.size(starts) == 0)
        whole = F.array(F.when(is_html(body), body).otherwise(strip(body)))
        parts = F.filter(F.concat(F.array(latest), _quoted_parts(lines, starts)), lambda t: t != "")
        return F.struct((~plain).alias("parsed"), F.when(plain, whole).otherwise(parts).alias("segments"))

    return let(lines_of(body), lambda lines: let(quote_starts(lines), lambda starts: split(lines, starts)))


# --- sections ---


def normalize_text(x: Column) -> Column:
    """Without control characters and zero-width spaces, with plain spaces and line feeds."""
    clean = F.regexp_replace(x, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\u200B]", "")
    clean = F.translate(F.replace(F.translate(clean, NBSP, " "), F.lit("\r\n"), F.lit("\n")), "\r", "\n")
    return F.when(x.rlike("[\\x00-\\x08\\x0B-\\x1F\\x7F\u200B\u00A0]"), clean).otherwise(x)  # most texts have none of these


def collapse_lines(x: Column) -> Column:
    """Single spaces within lines, no blank lines."""
    single = F.regexp_replace(x, r"[ \t]{2,}|\t", " ")
    return strip(F.regexp_replace(single, rf"[{BLANK}]*\n[{BLANK}]*", "\n"))


def redact_credentials(x: Column) -> Column:
    return F.regexp_replace(x, CREDENTIAL, "[credential redacted]")


def before_signature(x: Column, delimiters: Sequence[str]) -> Column:
    """Lines before the first that starts with a delimiter, all where there is none."""
    lines = lines_of(x)

    def signs(line: Column) -> Column:
        low, hit = F.lower(strip(line)), F.lit(False)
        for d in delimiters:
            hit = hit | low.startswith(d.lower())
        return hit

    held = F.lit(False)
    for d in delimiters:
        held = held | F.lower(x).contains(d.lower())
    at = F.when(held, F.array_position(F.transform(lines, signs), True)).otherwise(0)  # few texts hold one at all
    return let(at, lambda n: F.when(n > 0, F.array_join(F.slice(lines, F.lit(1), (n - 1).cast("int")), "\n")).otherwise(x))


def without_disclaimers(x: Column, patterns: Sequence[str]) -> Column:
    def without(v: Column, pattern: str) -> Column:
        return let(F.regexp_replace(v, "(?is)" + pattern, ""), lambda removed: F.when(removed != v, collapse_lines(removed)).otherwise(v))

    def step(pattern: str) -> Callable[[Column], Column]:
        return lambda v: without(v, pattern)

    for pattern in patterns:
        x = let(x, step(pattern))
    return x


def clean_section(x: Column, policy: CleaningPolicy) -> Column:
    """struct(text, flags) of a message section without signature, disclaimers and credentials."""

    def result(normal: Column, cut: Column, collapsed: Column, redacted: Column, text: Column) -> Column:
        flags = F.array(
            F.when(F.length(cut) != F.length(normal), "signature_removed"),
            F.when(redacted != collapsed, "credential_redacted"),
            F.when(text != redacted, "disclaimer_removed"),
        )
        return F.struct(text.alias("text"), F.array_compact(flags).alias("flags"))

    def after_cut(normal: Column, cut: Column) -> Column:
        return let(
            collapse_lines(cut),
            lambda collapsed: let(
                redact_credentials(collapsed),
                lambda redacted: let(without_disclaimers(redacted, policy.disclaimer_patterns), lambda text: result(normal, cut, collapsed, redacted, text)),
            ),
        )

    return let(normalize_text(x), lambda normal: let(before_signature(normal, policy.signature_delimiters), lambda cut: after_cut(normal, cut)))


def capped(x: Column, most: int) -> Column:
    return F.when(F.length(x) > most, strip(F.substring(x, 1, most))).otherwise(x)


def attachment_list(names: Column) -> Column:
    """Distinct trimmed names, first occurrences in order, joined."""
    return F.array_join(F.array_distinct(F.filter(F.transform(names, strip), lambda n: n != "")), ", ")


def meaningful_length(x: Column) -> Column:
    """Letters, digits and underscores of any script."""
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}_]", ""))


def truncate_body(body: Column, most: int, tail: int = 8000) -> Column:
    """Head and tail of a long body, with a mark between."""
    tail = min(tail, most // 2)
    cut = F.concat(F.substring(body, 1, most - tail), F.lit("\n[truncated]\n"), F.substring(body, -tail, tail))
    return F.when(F.length(body) > most, cut).otherwise(body)


# --- codes and labels ---


def normal_codes(*codes: Column) -> Column:
    """Distinct short codes of possibly dotted ones, in order."""
    parts = F.split(F.concat_ws(".", *codes), r"\.")
    return F.array_distinct(F.filter(F.transform(parts, strip), lambda c: (c != "") & ~F.lower(c).isin(*NO_CODE)))


def label_path(l1: Column, l2: Column, l3: Column) -> Column:
    return F.concat_ws(".", l1, l2, l3)


def split_label_path(label: Column) -> Column:
    """struct(l1, l2, l3) of a dotted label; missing levels repeat the last, an empty label is unknown."""
    parts = F.filter(F.split(label, r"\."), lambda p: p != "")
    at = lambda n: F.get(parts, F.lit(n))
    l1 = F.coalesce(at(0), F.lit("unknown"))
    l2 = F.coalesce(at(1), l1)
    return F.struct(l1.alias("l1"), l2.alias("l2"), F.coalesce(at(2), l2).alias("l3"))


def labels_match(rule_label: Column, llm_path: Column) -> Column:
    """Equal paths, or equal last parts."""
    last = lambda x: F.element_at(F.split(x, r"\."), -1)
    return (rule_label == llm_path) | (last(rule_label) == last(llm_path))


# --- identities ---


def dedup_key(message_id: Column, raw: Column) -> Column:
    """The lowered message id, else a digest of the bytes."""
    return F.when(F.trim(F.coalesce(message_id, F.lit(""))) != "", F.lower(F.trim(message_id))).otherwise(F.sha2(raw, 256))


def mail_hash(subject: Column, sender: Column, received_at: Column) -> Column:
    """Digest of subject, sender and the ISO form of a UTC timestamp."""
    return F.sha2(F.concat_ws("|", subject, sender, F.date_format(received_at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")), 256)


def fingerprint(text: Column) -> Column:
    """Digest of a retrieval text that trailing blanks don't change."""
    return F.sha2(F.array_join(F.transform(lines_of(strip(text)), lambda line: F.regexp_replace(line, rf"[{BLANK}]+$", "")), "\n"), 256)
