"""Text, key and date derivations as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termwell.functions.literals import no_texts, sql_array, text_array
from termwell.functions.patterns import FLAGS
from termwell.vocab.listing import MONTH_SPELLINGS, ROLLING_DEADLINES, UNDATED_WORDS


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of the text, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def index_text(name: Column, section: Column, region: Column, category: Column,
               tags: Column, text: Column) -> Column:
    """Text to index: name and tags weigh double by standing in it twice."""
    tag_text = F.array_join(tags, " ")
    parts = [name, name, section, region, category, tag_text, tag_text, text]
    return F.concat_ws(" ", *[text_or_empty(part) for part in parts])


def embed_text(name: Column, category: Column, region: Column, tags: Column, text: Column) -> Column:
    """Prose form of a chunk, for computing its vector."""
    return F.concat(
        name, F.lit(" is a "), category, F.lit(" examination in "), region,
        F.lit(". Subjects and keywords: "), F.array_join(F.slice(tags, 1, 6), ", "),
        F.lit(". "), F.substring(text, 1, 400),
    )


def dashed(text: Column) -> Column:
    """Lower-case text with every other character run turned into one dash."""
    return F.regexp_replace(
        F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""
    )


def slug(name: Column, org: Column | None = None) -> Column:
    full = name if org is None else F.concat(name, F.lit("-"), org)
    return F.substring(dashed(full), 1, 50)


def stable_id(name: Column, org: Column) -> Column:
    """Readable id that stays the same for the same name and organiser."""
    full = F.concat(name, F.lit("-"), org)
    digest = F.sha1(F.lower(full).cast("binary"))
    return F.concat(F.substring(dashed(full), 1, 40), F.lit("-"), F.substring(digest, 1, 6))


def squeezed(text: Column) -> Column:
    """Trimmed lower-case text with white space runs turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def identity_key(name: Column, org: Column) -> Column:
    return F.concat(squeezed(name), F.lit("|"), squeezed(org))


def fingerprint(name: Column, org: Column) -> Column:
    return F.concat(F.lower(name), F.lit("|"), F.lower(org))


def _months_mentioned(text: Column) -> Column:
    """The months mentioned in the text, in calendar order.

    All spellings of a month contain its first, so only that one is looked for.
    """
    table = F.expr("array(" + ", ".join(
        f"named_struct('spellings', {sql_array(spellings)}, 'number', '-{number:02d}')"
        for number, spellings in enumerate(MONTH_SPELLINGS, start=1)
    ) + ")")
    mentioned = F.transform(
        F.array(F.lower(text)), lambda low: F.filter(table, lambda month: F.contains(low, month["spellings"][0]))
    )
    return mentioned[0]


def months_in(text: Column) -> Column:
    """All spellings of every month mentioned in the text, in calendar order."""
    return F.flatten(_months_mentioned(text)["spellings"])


def years_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAGS + r"\b(20[0-9]{2})\b"), F.lit(1))


def is_year_round(date: Column) -> Column:
    lowered = F.lower(text_or_empty(date))
    return F.contains(lowered, F.lit("year")) & F.contains(lowered, F.lit("round"))


def date_sortable(date: Column) -> Column:
    """``YYYY-MM`` or ``YYYY`` of a free-text date; null when it has none."""
    lowered = F.lower(date)
    undated = F.exists(text_array(UNDATED_WORDS), lambda word: F.contains(lowered, word))
    year = F.nullif(F.regexp_extract(date, FLAGS + r"\b(20[0-9]{2})\b", 1), F.lit(""))
    month = F.coalesce(F.try_element_at(_months_mentioned(date)["number"], F.lit(1)), F.lit(""))
    return F.when(~undated, F.concat(year, month))


def overview_text(row: dict[str, Column]) -> Column:
    described = F.concat(F.lit(" "), F.trim(row["description"]))
    return F.concat(
        row["name"], F.lit(" is a "), F.lower(row["category"]), F.lit(" exam administered by "), row["org"],
        F.lit(". Region: "), row["region"],
        F.lit(". Available in: "), F.array_join(F.slice(row["countries"], 1, 6), ", "),
        F.lit(". Date: "), row["date"],
        F.lit(". Registration deadline: "), row["deadline"],
        F.lit(". Difficulty: "), row["difficulty"],
        F.lit(". Duration: "), row["duration"],
        F.lit(". Cost: "), row["cost"], F.lit("."),
        F.when(text_or_empty(row["description"]) != "", described).otherwise(F.lit("")),
    )


def subjects_text(row: dict[str, Column]) -> Column:
    return F.concat(
        row["name"], F.lit(" — Subjects: "), F.array_join(F.slice(row["subjects"], 1, 8), ", "),
        F.lit(". Keywords: "), F.array_join(F.slice(row["tags"], 1, 10), " "),
        F.lit(". Org: "), row["org"], F.lit(". Category: "), row["category"],
        F.lit(". Region: "), row["region"], F.lit("."),
    )


def _sentences(words: Column, template: str, name: Column) -> Column:
    """One sentence group per distinct word; ``{w}`` and ``{n}`` are filled in."""
    def fill(word: Column) -> Column:
        parts = []
        for piece in template.replace("{w}", "\0w\0").replace("{n}", "\0n\0").split("\0"):
            if piece == "w":
                parts.append(word)
            elif piece == "n":
                parts.append(name)
            elif piece:
                parts.append(F.lit(piece))
        return F.concat(*parts)

    return F.transform(F.sort_array(F.array_distinct(words)), fill)


def deadline_text(row: dict[str, Column]) -> Column:
    """Date-dense text: months and years stand in it in several sentences each."""
    name, date, deadline = row["name"], row["date"], row["deadline"]
    year_round = is_year_round(date)
    exam_months, exam_years = months_in(date), years_in(date)
    due_months, due_years = months_in(deadline), years_in(deadline)
    all_months = F.sort_array(F.array_union(exam_months, due_months))
    all_years = F.sort_array(F.array_union(exam_years, due_years))
    none = no_texts()

    def one(text: Column, condition: Column | None = None) -> Column:
        return F.array(text) if condition is None else F.when(condition, F.array(text)).otherwise(none)

    always = F.concat(
        one(F.concat(name, F.lit(" is available year round with no fixed exam date."))),
        one(F.concat(name, F.lit(" can be taken any time of year."))),
    )
    scheduled = F.concat(
        one(F.concat(name, F.lit(" exam date: "), date, F.lit("."))),
        one(
            F.concat(name, F.lit(" is scheduled in "), date, F.lit(". Month: "),
                     F.array_join(exam_months, " "), F.lit(".")),
            F.size(exam_months) > 0,
        ),
        one(
            F.concat(name, F.lit(" exam year: "), F.array_join(exam_years, " "), F.lit(".")),
            F.size(exam_years) > 0,
        ),
        _sentences(exam_months, "Exam taking place in {w}. {n} {w} exam. {w} examination {n}.", name),
        _sentences(exam_years, "{n} {w} exam. Examination in {w}.", name),
    )
    due = F.concat(
        one(F.concat(name, F.lit(" registration deadline: "), deadline, F.lit("."))),
        one(
            F.concat(
                F.lit("Register for "), name, F.lit(" before "), deadline,
                F.lit(". Application closes "), F.array_join(due_months, " "),
                F.lit(". Deadline month: "), F.array_join(due_months, " "), F.lit("."),
            ),
            F.size(due_months) > 0,
        ),
        _sentences(
            due_months,
            "Closing date in {w}. Register by {w}. {n} {w} deadline. Application deadline {w}.",
            name,
        ),
        _sentences(due_years, "Deadline in {w}. Registration closes {w}.", name),
    )
    rolling = one(F.concat(name, F.lit(" has a rolling registration deadline — apply any time.")))
    summary = F.concat(
        one(
            F.concat(
                name, F.lit(" relevant months: "), F.array_join(all_months, ", "),
                F.lit(". Category: "), row["category"], F.lit(". Region: "), row["region"], F.lit("."),
            ),
            F.size(all_months) > 0,
        ),
        one(
            F.concat(
                name, F.lit(" relevant years: "), F.array_join(all_years, ", "),
                F.lit(". Upcoming in "), F.array_join(all_years, ", "), F.lit("."),
            ),
            F.size(all_years) > 0,
        ),
        one(
            F.concat(name, F.lit(" ongoing exam. Available throughout the year. No specific month required.")),
            year_round,
        ),
    )
    return F.array_join(
        F.concat(
            F.when(year_round, always).otherwise(scheduled),
            F.when(F.lower(deadline).isin(ROLLING_DEADLINES), rolling).otherwise(due),
            summary,
        ),
        " ",
    )


def settings_text(pairs: list[tuple[str, Column]]) -> Column:
    """``key=value`` list of the settings that are set; "none" without any."""
    shown = F.concat_ws(", ", *[
        F.when(text_or_empty(value) != "", F.concat(F.lit(f"{key}="), value)) for key, value in pairs
    ])
    return F.coalesce(F.nullif(shown, F.lit("")), F.lit("none"))


def constraint_text(row: dict[str, Column]) -> Column:
    """Settings in force for one request, defaults left out."""
    def unless(value: Column, default: str) -> Column:
        return F.when(value != default, value)

    return settings_text([
        ("region", row["region"]),
        ("category", row["category"]),
        ("difficulty", row["difficulty"]),
        ("focus", unless(row["focus"], "broad")),
        ("sort", unless(row["sort_by"], "relevance")),
        ("year", row["year"].cast("string")),
        ("month", row["month"]),
        ("countries", F.array_join(F.slice(row["countries"], 1, 3), ",")),
        ("free_only", F.when(row["free_only"], F.lit("true"))),
    ])


def _bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda item: F.concat(F.lit("- "), item)), "\n")


def prompt_text(row: dict[str, Column]) -> Column:
    """The retrieval request of a row as text: query, intent hints, strict filters."""
    def strict(label: str, value: Column) -> Column:
        wanted = ~F.lower(text_or_empty(value)).isin("all", "")
        return F.when(wanted, F.concat(F.lit(f"{label}: "), value))

    def given(value: Column) -> Column:
        return text_or_empty(value) != ""

    hints = F.array_compact(F.array(
        F.when(row["sort_hint"] != "relevance", F.concat(F.lit("Sort by: "), row["sort_hint"])),
        F.when(row["free_hint"], F.lit("Only return free or zero-cost exams (cost_usd = 0)")),
        F.concat(F.lit("Prefer exams with dates in "), row["year_hint"].cast("string")),
        F.concat(F.lit("Prefer exams scheduled in "), row["month_hint"]),
        F.when(
            F.size(row["country_hints"]) > 0,
            F.concat(F.lit("Must be available in at least one of: "), F.array_join(row["country_hints"], ", ")),
        ),
        F.when(
            given(row["category_hint"]) & ~given(row["category"]),
            F.concat(F.lit("Likely category: "), row["category_hint"]),
        ),
    ))
    filters = F.array_compact(F.array(
        strict("Region", row["region"]),
        strict("Category", row["category"]),
        strict("Difficulty", row["difficulty"]),
    ))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Search query: "), row["query"]),
        F.when(F.size(hints) > 0, F.concat(F.lit("\nSearch intent (honour these):\n"), _bullets(hints))),
        F.when(F.size(filters) > 0, F.concat(F.lit("\nStrict filters:\n"), _bullets(filters))),
        F.lit("\nReturn JSON array now."),
    )


def clipped_context(context: Column) -> Column:
    """Description taken from a retrieval context: its first 480 characters."""
    return F.trim(F.substring(context, 1, 480))


def request_key(query: Column, *settings: Column) -> Column:
    """Short digest of a request; equal for requests equal but for letter case."""
    parts = [F.trim(F.lower(query))] + [F.lower(text_or_empty(value)) for value in settings]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def sanitised(text: Column) -> Column:
    """Text without control characters, white space collapsed."""
    visible = F.regexp_replace(text, r"[\p{C}&&[^\t\n]]", "")
    return F.trim(F.regexp_replace(visible, r"(?U)\s+", " "))


def contextual_query(query: Column, region: Column, difficulty: Column, month: Column,
                     year: Column, free_only: Column) -> Column:
    """The query, or one made of the active filters where it is blank."""
    def active(value: Column, inactive: str) -> Column:
        return F.when(value != inactive, value)

    parts = F.concat_ws(
        " ",
        active(region, "All"),
        F.lower(active(difficulty, "All")),
        active(month, "Any month"),
        active(year, "Any year"),
        F.when(free_only, F.lit("free")),
    )
    from_filters = F.when(parts != "", F.concat(parts, F.lit(" examinations")))
    return F.coalesce(F.nullif(F.trim(query), F.lit("")), from_filters, F.lit("popular global examinations"))


BOLD_PATTERN = r"(?d)\*\*(.+?)\*\*"


def bold_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(BOLD_PATTERN), F.lit(1))


def bold_to_html(text: Column) -> Column:
    return F.regexp_replace(text, BOLD_PATTERN, "<strong>$1</strong>")
