"""Column expressions for addresses, delivery details and time labels. No Python runs on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The address of mail that nobody can get: bounces of bounces.
NOWHERE = "#@[]"
#: TAI64N labels count from here, and TAI ran 10 seconds ahead when the format was fixed.
TAI_START, TAI_AHEAD = 1 << 62, 10

# Formats of delivery details.
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"
SAID = "Remote_host_said:_"
RESPONSE = SAID + r"([0-9]{3})(?:_([0-9]\.[0-9]{1,3}\.[0-9]{1,3}))?"
OWN_STATUS = r"\(#([0-9]\.[0-9]{1,3}\.[0-9]{1,3})\)"
GIVING_UP = "Giving_up_on_[^/]*/?"
DISLIKES = r"^[^/]*_does_not_like_recipient\./"


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fold(address: Column) -> Column:
    return F.lower(strip(address))


def domain_of(address: Column) -> Column:
    """What follows the last @; null without one or if nothing follows."""
    return F.when(address.contains("@"), F.nullif(F.substring_index(address, "@", -1), F.lit("")))


def without_prefix(address: Column) -> Column:
    """domain-user@domain becomes user@domain; other addresses stay."""
    domain = F.substring_index(address, "@", -1)
    local = F.substr(address, F.lit(1), F.char_length(address) - F.char_length(domain) - 1)
    prefix = F.concat(domain, F.lit("-"))
    rest = F.substr(local, F.char_length(prefix) + 1)
    carries = address.contains("@") & F.startswith(local, prefix) & (F.char_length(local) > F.char_length(prefix))
    return F.when(carries, F.concat(rest, F.lit("@"), domain)).otherwise(address)


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _tidy(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" -"))


def detail_ip(detail: Column) -> Column:
    return _found(detail, f"({IP})", 1)


def detail_code(detail: Column) -> Column:
    return _found(detail, RESPONSE, 1).try_cast("int")


def detail_status(detail: Column) -> Column:
    return F.coalesce(_found(detail, RESPONSE, 2), _found(detail, OWN_STATUS, 1))


def detail_reason(detail: Column) -> Column:
    """What is left of a detail without addresses, codes and numbers, so that causes repeat; null if nothing is."""
    text = F.regexp_replace(detail, OWN_STATUS, "")
    text = F.regexp_replace(text, GIVING_UP, "")
    text = F.regexp_replace(text, DISLIKES, "")
    text = F.replace(text, F.lit(SAID), F.lit(""))
    stated = F.coalesce(F.replace(F.regexp_extract(detail, RESPONSE, 0), F.lit(SAID), F.lit("")), F.lit(""))
    at = F.position(stated, text)
    text = F.when((stated != "") & (at > 0), F.overlay(text, F.lit(""), at, F.char_length(stated))).otherwise(text)
    text = F.translate(F.regexp_replace(text, IP, ""), "_/", "  ")
    return F.nullif(_tidy(F.regexp_replace(text, r"(?U)\b\d+\b", "#")), F.lit(""))


def readable_detail(detail: Column) -> Column:
    """The far end's own words; empty for a null detail."""
    text = F.regexp_replace(F.coalesce(detail, F.lit("")), GIVING_UP, "")
    text = F.replace(F.regexp_replace(text, DISLIKES, ""), F.lit(SAID), F.lit(""))
    text = F.regexp_replace(text, r"/\s*$", "")
    text = F.regexp_replace(text, "/(?=[A-Z][a-z]+_)", " ")
    return _tidy(F.translate(text, "_", " "))


def failure_side(result: Column, code: Column, said: Column, route: Column) -> Column:
    """Whose problem a failed attempt is, by route, code, enhanced code and wording, in this order."""
    text = F.lower(F.coalesce(said, F.lit("")))
    words = F.split(F.coalesce(said, F.lit("")), r"\s+")
    enhanced = F.coalesce(F.get(F.filter(words, lambda w: w.rlike(r"^[0-9]*\.[0-9]*\.[0-9]*$") & w.rlike("[0-9]")), F.lit(0)), F.lit(""))
    begins = lambda *x: enhanced.rlike("^(?:" + "|".join(v.replace(".", r"\.") for v in x) + ")")
    names_recipient = text.contains("recipient address rejected") | text.contains("destinatario")
    return (
        F.when((F.coalesce(route, F.lit("")) == "local") | text.contains("over quota"), "our side")
        .when((result == "deferral") | F.coalesce(code.between(400, 499), F.lit(False)), "temporary")
        .when(begins("5.1", "5.2", "5.4"), "their side")
        .when(begins("5.7"), F.when(names_recipient, "their side").otherwise("check ours"))
        .when(F.coalesce(code.between(500, 599), F.lit(False)), "their side")
        .otherwise("unknown")
    )


def block_state(action: Column) -> Column:
    return F.when(action == "ban", "blocked").when(action.isNotNull(), "ban expired").otherwise("not blocked")


def rate(part: Column, whole: Column) -> Column:
    """Percentage with two places, null without a whole. Halves are rounded away from zero."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, 2))


def tai64n(line: Column) -> Column:
    """The time of a line's TAI64N label, null without one."""
    label = F.regexp_extract(line, r"^@([0-9a-f]{24})\b", 1)
    seconds = F.conv(F.substring(label, 1, 16), 16, 10).try_cast("decimal(20,0)") - TAI_START - TAI_AHEAD
    micros = F.floor(F.conv(F.substring(label, 17, 8), 16, 10).try_cast("bigint") / 1000)
    return F.when(label != "", F.timestamp_micros((seconds * 1_000_000 + micros).cast("bigint")).cast("timestamp_ntz"))


def after_label(line: Column) -> Column:
    return F.when(line.rlike(r"^@[0-9a-f]{24}\b"), F.ltrim(F.substr(line, F.lit(26))))


def week(ts: Column) -> Column:
    """ISO year and week, as 2024-W05."""
    return F.concat(F.extract(F.lit("yearofweek"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def rounded_to_ms(ts: Column) -> Column:
    """A zoneless time rounded to milliseconds."""
    micros = F.unix_micros(ts.cast("timestamp"))
    return F.timestamp_millis(F.round(micros / 1000).cast("bigint")).cast("timestamp_ntz")
