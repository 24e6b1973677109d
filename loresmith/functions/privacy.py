"""De-identification: links, mentions, names, clock times and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loresmith import vocab
from loresmith.config import PRIVACY, PrivacyPolicy
from loresmith.functions.lookup import let, lookup
from loresmith.functions.text import SPACE, SPACES, clip, holds, replaced, squeeze

# --- fixed values: patterns ------------------------------------------------------------------------------------------
NAME_TEAM = r"([가-힣]{2,4})\[([^\[\]]{1,30})\]"
AT_MENTION = rf"@{SPACE}*([가-힣A-Za-z0-9_]{{2,30}})(?:\[([^\[\]]{{1,30}})\])?"
INNER_MENTION = r"<@[A-Z0-9]+>"
URL = rf"https?://[^{SPACES})>\]]+"
DRIVE = rf"(drive\.google\.com|docs\.google\.com)[^{SPACES})>\]]*"
# Word edges between letters, digits and underscores of any script; the short sign for them depends on the Java version.
WORD = r"[\p{L}\p{N}_]"
EDGE = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
IMAGE_EXTENSIONS, OFFICE_EXTENSIONS = "png|jpg|jpeg|gif|bmp|webp", "xlsx|xlsm|docx|pdf|csv"
IMAGE_FILE = rf"(?i){EDGE}[^{SPACES}]+\.({IMAGE_EXTENSIONS}){EDGE}"
OFFICE_FILE = rf"(?i){EDGE}[^{SPACES}]+\.({OFFICE_EXTENSIONS}){EDGE}"
FILE_COUNT = rf"{EDGE}\d+{SPACE}*개{SPACE}*파일{EDGE}"
DATE_FULL = rf"(\d{{4}}){SPACE}*년{SPACE}*(\d{{1,2}}){SPACE}*월{SPACE}*(\d{{1,2}}){SPACE}*일"
DATE_DASH = rf"{EDGE}(20\d{{2}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){EDGE}"
DATE_SHORT = rf"{EDGE}(\d{{1,2}})/(\d{{1,2}}){EDGE}(?!\d)"
CLOCK = r"(\d{1,2}):(\d{2})"

# Hours as patterns, by the bucket they fall into (24-hour, with a morning mark, with an afternoon mark).
HOUR_0_11, HOUR_0_12 = "(?:0?[0-9]|1[01])", "(?:0?[0-9]|1[0-2])"
HOUR_12_17, HOUR_13_17, HOUR_18_23 = "1[2-7]", "1[3-7]", "(?:1[89]|2[0-3])"
HOUR_PM_AFTERNOON, HOUR_PM_EVENING = "(?:0?[0-5]|1[2-7])", "(?:0?[6-9]|1[01]|1[89]|2[0-3])"
HOUR_LATE = "(?:2[4-9]|[3-9][0-9])"
BUCKET_HOURS = {
    "morning": (HOUR_0_11, HOUR_0_12, None),
    "afternoon": (HOUR_12_17, HOUR_13_17, HOUR_PM_AFTERNOON),
    "evening": (HOUR_18_23, HOUR_18_23, HOUR_PM_EVENING),
    "unknown": (HOUR_LATE, HOUR_LATE, HOUR_LATE),
}


def mask_mentions(text: Column) -> Column:
    text = replaced(text, holds("<@"), INNER_MENTION, vocab.MENTION_LABEL)
    return replaced(text, holds("@"), AT_MENTION, vocab.MENTION_LABEL)


def mask_links_and_files(text: Column) -> Column:
    for mark, pattern, label in (
        (holds("drive.google.com", "docs.google.com"), DRIVE, vocab.LINK_LABEL),
        (holds("://"), URL, vocab.LINK_LABEL),
        (lambda s: s.rlike(rf"(?i)\.(?:{IMAGE_EXTENSIONS})"), IMAGE_FILE, vocab.IMAGE_LABEL),
        (lambda s: s.rlike(rf"(?i)\.(?:{OFFICE_EXTENSIONS})"), OFFICE_FILE, vocab.FILE_LABEL),
        (holds("파일"), FILE_COUNT, vocab.ATTACHMENT_LABEL),
    ):
        text = replaced(text, mark, pattern, label)
    return text


def speaker_role(name: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    """bot, author or participant, by hints inside the name."""
    role = F.lit("participant")
    if policy.author_hints:
        role = F.when(mentions_exact(name, policy.author_hints), "author").otherwise(role)
    if policy.bot_hints:
        role = F.when(mentions_exact(name, policy.bot_hints), "bot").otherwise(role)
    return role


def mentions_exact(text: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return F.coalesce(found, F.lit(False))


def role_label(role: Column, number: Column) -> Column:
    """Label of a role; participants get the letter of their number (0 is A, everything from 25 on is Z)."""
    letter = F.chr(F.lit(65) + F.least(number, F.lit(25)))
    known = lookup(role, vocab.ROLE_LABELS, vocab.ROLE_LABELS["participant"])
    lettered = (role == "participant") & number.isNotNull() & (number >= 0)
    return F.when(lettered, F.concat(known, F.lit(" "), letter)).otherwise(known)


def pseudonymize_speakers(text: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    """Each ``name[team]`` becomes a label; the same name keeps the same letter, in order of first appearance."""

    def replace_all(given: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(given, F.lit(NAME_TEAM), 1))
        people = F.filter(names, lambda n: speaker_role(n, policy) == "participant")

        def replace_one(acc: Column, name: Column) -> Column:
            # The grammar takes the last two to four syllables before the bracket: a shorter name has none before it.
            guard = F.when(F.length(name) < 4, F.lit("(?<![가-힣])")).otherwise(F.lit(""))
            number = (F.array_position(people, name) - 1).cast("int")
            pattern = F.concat(guard, name, F.lit(r"\[[^\[\]]{1,30}\]"))
            return F.regexp_replace(acc, pattern, role_label(speaker_role(name, policy), number))

        return F.when(given.rlike(NAME_TEAM), F.aggregate(names, given, replace_one)).otherwise(given)

    return let(text, replace_all)


def time_bucket(time: Column) -> Column:
    """morning, afternoon, evening or unknown for a written clock time."""
    return let(F.trim(F.coalesce(time, F.lit(""))), _bucket_of)


def _bucket_of(s: Column) -> Column:
    am = F.contains(s, F.lit("오전")) | F.endswith(F.lower(s), F.lit("am"))
    pm = ~am & (F.contains(s, F.lit("오후")) | F.endswith(F.lower(s), F.lit("pm")))
    hour = F.try_to_number(F.nullif(F.regexp_extract(s, CLOCK, 1), F.lit("")), F.lit("99")).cast("int")
    hour = let(hour, lambda h: F.when(pm & (h < 12), h + 12).when(am & (h == 12), 0).otherwise(h))
    named = lambda h: (
        F.when(h.between(0, 11), "morning")
        .when(h.between(12, 17), "afternoon")
        .when(h.between(18, 23), "evening")
        .otherwise("unknown")
    )
    return let(hour, named)


def bucket_label(bucket: Column) -> Column:
    return lookup(bucket, vocab.BUCKET_LABELS, vocab.BUCKET_LABELS["unknown"])


def time_range_display(buckets: Column) -> Column:
    """Labels of the first two different buckets."""
    first = F.slice(F.array_distinct(F.filter(buckets, lambda b: b != "")), 1, 2)
    return F.when(F.size(first) > 0, F.array_join(F.transform(first, bucket_label), " · ")).otherwise(
        vocab.BUCKET_LABELS["unknown"]
    )


def anonymize_timestamp(time: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    given = F.coalesce(time, F.lit(""))
    if policy.show_times:
        return given
    return F.when(given == "", "").otherwise(bucket_label(time_bucket(given)))


def _bracket_pattern(hours: tuple) -> str:
    """Inside brackets only the Korean marks count; a Latin mark is followed by the bracket and read as 24-hour."""
    plain, am, pm = hours
    forms = [rf"(?:AM|PM|am|pm)?\s*{plain}", rf"오전\s*{am}"] + ([rf"오후\s*{pm}"] if pm else [])
    return rf"\[\s*(?:{'|'.join(forms)}):\d{{2}}\s*\]"


def _inline_pattern(hours: tuple) -> str:
    plain, am, pm = hours
    forms = [rf"{am}:\d{{2}}\s*(?:오전|AM|am)"] + ([rf"{pm}:\d{{2}}\s*(?:오후|PM|pm)"] if pm else [])
    forms.append(rf"{plain}:\d{{2}}(?!\s*(?:오전|오후|AM|PM|am|pm))\s*")
    return rf"(?<![\d:])(?:{'|'.join(forms)})"


def generalize_times(text: Column) -> Column:
    """Clock times become ``[label]``: one pass per bucket, first the bracketed ones; texts without a clock are skipped."""

    def replace_all(given: Column) -> Column:
        done = given
        for build in (_bracket_pattern, _inline_pattern):
            for bucket, hours in BUCKET_HOURS.items():
                done = F.regexp_replace(done, build(hours), f"[{vocab.BUCKET_LABELS[bucket]}]")
        return F.when(given.rlike(CLOCK), done).otherwise(given)

    return let(text, replace_all)


def generalize_dates(text: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    if policy.show_dates:
        return text
    for mark, pattern in (
        (holds("년"), DATE_FULL), (lambda s: s.rlike(r"20\d{2}[-/.]\d"), DATE_DASH), (lambda s: s.rlike(r"\d/\d"), DATE_SHORT),
    ):
        text = replaced(text, mark, pattern, f"해당 {policy.date_label}")
    return text


def display_date(document_date: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    """What to show for a document date: ``-`` when unknown, the date when allowed, else the label."""
    text = document_date.cast("string")
    shown = text if policy.show_dates or not policy.anonymize else F.lit(f"해당 {policy.date_label}")
    return F.when(F.coalesce(text, F.lit("")) == "", "-").otherwise(shown)


def anonymize(text: Column, policy: PrivacyPolicy = PRIVACY) -> Column:
    """The whole chain in order: links, mentions, names, times, dates."""
    if not policy.anonymize:
        return text
    if policy.mask_links:
        text = mask_links_and_files(text)
    if policy.mask_mentions:
        text = mask_mentions(text)
    if not policy.show_names:
        text = pseudonymize_speakers(text, policy)
    if not policy.show_times:
        text = generalize_times(text)
    return generalize_dates(text, policy)


def preview(text: Column, n: int = 240, policy: PrivacyPolicy = PRIVACY) -> Column:
    """A short de-identified extract on one line."""
    return clip(squeeze(anonymize(F.coalesce(text, F.lit("")), policy)), n)
