"""Text expressions: matching, market names, phones, chat commands, templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from furrow import constants as K
from furrow.functions.arrays import bind
from furrow.functions.numbers import lookup


def same_text(left: Column, right: Column | str) -> Column:
    """Case-insensitive equality."""
    right = F.lit(right) if isinstance(right, str) else right
    return F.lower(left) == F.lower(right)


def like_text(value: Column, pattern: str) -> Column:
    """Case-insensitive LIKE, wildcards honoured."""
    return value.ilike(pattern)


def market_contains(market: Column, needle: Column | str) -> Column:
    """Substring match on lower-cased names; an empty or missing name passes."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    name = F.coalesce(market, F.lit(""))
    return F.contains(F.lower(name), F.lower(needle)) | (name == "")


def market_key(payload: Column) -> Column:
    """Market name of a JSON payload, whichever key carries it."""
    return F.coalesce(
        *[F.get_json_object(payload, f"$.{k}") for k in ("market_name", "mandi", "market")]
    )


def series_stem(crop: Column, mandi: Column) -> Column:
    """Lower-case key of a series, spaces replaced."""
    return F.concat_ws("_", F.lower(crop), F.replace(F.lower(mandi), F.lit(" "), F.lit("_")))


def target_phone(subscription_phone: Column, user_phone: Column) -> Column:
    """Delivery address: own phone first, country and channel prefixes added."""
    def given(c: Column) -> Column:
        return F.when(c != "", c)

    phone = F.coalesce(given(subscription_phone), given(user_phone))
    return (
        F.when(phone.startswith("whatsapp:"), phone)
        .when(phone.startswith("+"), F.concat(F.lit("whatsapp:"), phone))
        .otherwise(F.concat(F.lit("whatsapp:+91"), phone))
    )


def sanitise(value: Column) -> Column:
    """Letters, digits, blanks and hyphens only; trimmed; at most 50 characters."""
    return F.substring(F.trim(F.regexp_replace(value, r"[^a-zA-Z0-9 \-]", "")), 1, 50)


def tokens(body: Column) -> Column:
    """Lower-case words of a message; an empty array for a blank message."""
    clean = F.regexp_replace(F.lower(body), r"^\s+|\s+$", "")
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"\s+"))


def classify(body: Column) -> Column:
    """Struct (command, crop, mandi, lang) of a chat message."""

    def word(words: Column, i: int) -> Column:
        return F.coalesce(F.get(words, F.lit(i)), F.lit(""))

    def rest(words: Column, start: int) -> Column:
        count = F.greatest(F.size(words) - (start - 1), F.lit(0))
        return F.array_join(F.slice(words, start, count), " ")

    def kind_of(words: Column) -> Column:
        n, first = F.size(words), word(words, 0)
        return (
            F.when(n == 0, "help")
            .when((n == 2) & (first == "language") & word(words, 1).isin(K.LANGUAGES), "language")
            .when((n == 1) & first.isin(K.HELP_WORDS), "help")
            .when(first.isin("subscribe", "history") & (n >= 3), first)
            .when((n >= 2) & ~first.isin("subscribe", "history", "help", "language"), "forecast")
            .otherwise("other")
        )

    def arguments(parsed: Column) -> Column:
        words, kind = parsed["words"], parsed["kind"]
        keyword = kind.isin("subscribe", "history")
        crop = F.when(keyword, word(words, 1)).when(kind == "forecast", word(words, 0))
        mandi = F.when(keyword, rest(words, 3)).when(kind == "forecast", rest(words, 2))
        return F.struct(
            kind.alias("kind"),
            sanitise(crop).alias("crop"),
            sanitise(mandi).alias("mandi"),
            F.when(kind == "language", word(words, 1)).alias("lang"),
        )

    def outcome(a: Column) -> Column:
        # an argument with nothing left after cleaning is answered with an error
        bad = F.coalesce((a["crop"] == "") | (a["mandi"] == ""), F.lit(False))
        return F.struct(
            F.when(bad, "error").otherwise(a["kind"]).alias("command"),
            F.when(~bad, a["crop"]).alias("crop"),
            F.when(~bad, a["mandi"]).alias("mandi"),
            a["lang"].alias("lang"),
        )

    parsed = bind(
        tokens(body), lambda w: F.struct(w.alias("words"), kind_of(w).alias("kind"))
    )
    return bind(bind(parsed, arguments), outcome)


def title_case(value: Column) -> Column:
    return F.initcap(value)


def render(template: Column, slots: dict[str, Column]) -> Column:
    """Replace each ``{slot}`` by its value."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def template_for(lang: Column, templates: dict[str, str]) -> Column:
    """Template of a language; English when the language is unknown."""
    return F.coalesce(lookup(F.lower(lang), templates), F.lit(templates["english"]))
