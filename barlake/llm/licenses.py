"""License scans: known licence sentences to identifiers, identifier sequences to ordered rules."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import read_table

# Sentences of public licences, lower case, letters and digits only, with their identifiers.
SENTENCES = {
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 3": "gpl3_notice",
    "licensed under the gnu general public license version 2": "gpl2_notice",
    "licensed under cc by nc 4 0": "ccbync4_notice",
    "licensed under cc by 4 0": "ccby4_notice",
    "licensed under cc by sa 4 0": "ccbysa4_notice",
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "mit license": "mit_title",
    "licensed under the apache license version 2 0": "apache2_notice",
    "licensed under the apache license version 2 0 the license": "apache2_notice",
    "apache license": "apache_title",
    "version 2 0 january 2004": "apache2_date",
    "you may not use this file except in compliance with the license": "apache_comply",
    "you may obtain a copy of the license at": "apache_copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache_see",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "mit_notice_kept",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
    " products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties"
    " including but not limited to the implied warranties of merchantability and fitness for a particular purpose are"
    " disclaimed": "bsd_as_is",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
    " license as published by the free software foundation either version 3 of the license or at your option any later"
    " version": "gpl3_grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "gpl_warranty",
    "see the gnu general public license for more details": "gpl_details",
    "all rights reserved": "all_rights",
}

# Ordered rules. What a rule has matched is not matched again; longer rules come first.
RULES = (
    ("BSD-3-Clause", ("bsd_source", "bsd_binary", "bsd_names", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_source", "bsd_binary", "bsd_as_is")),
    ("GPL-3.0-or-later", ("gpl3_grant", "gpl_warranty", "gpl_details")),
    ("GPL-3.0-or-later", ("gpl3_grant",)),
    ("Apache-2.0", ("apache2_notice", "apache_comply", "apache_copy")),
    ("Apache-2.0", ("apache_title", "apache2_date")),
    ("MIT", ("mit_title", "mit_notice_kept", "mit_as_is")),
    ("MIT", ("mit_notice_kept", "mit_as_is")),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-2.0", ("gpl2_notice",)),
    ("CC-BY-NC-4.0", ("ccbync4_notice",)),
    ("CC-BY-SA-4.0", ("ccbysa4_notice",)),
    ("CC-BY-4.0", ("ccby4_notice",)),
    ("Apache-2.0", ("apache2_notice",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_title",)),
    ("All-Rights-Reserved", ("all_rights",)),
)

# Words that open a commented line or number a list entry; markers without letters or digits fall away by themselves.
_COMMENT, _NUMBER = "rem|dnl", "[0-9]{1,3}|[a-z]|[ivx]{2,4}"
_MARKER = f"(?:(?:{_NUMBER})[ &]|(?:{_COMMENT})[ \n]){{0,3}}"
_WRAP = f"\n(?:(?:{_COMMENT}) )?"

# Each run of other characters between two words becomes one sign: '%' ends a sentence and cannot be crossed (. ! ? before
# white space, an empty line), '&' does so behind a list marker on the same line, '\n' ends a line (a line break, a
# semicolon before white space), else ' '. Possessive repeats and the look at the character before keep every step linear
# in the length of a run.
_STEPS = (
    (r"(^|[\r\n])[^A-Za-z0-9\r\n]+", "$1"),
    (rf"(?i)((?:^|[\r\n])(?:(?:{_COMMENT})[ \t]+)?(?:{_NUMBER}))\.[ \t][^A-Za-z0-9\r\n]*+(?=[A-Za-z0-9])", "$1&"),
    (r"[.!?][ \t\r\n]+", "%"),
    (r";[ \t]", "~"),
    (r"(?>\r\n?|\n)[\r\n]+", "%"),
    (r"(?<![^A-Za-z0-9])[^A-Za-z0-9%]*+%[^A-Za-z0-9]*+", "%"),
    (r"(?<![^A-Za-z0-9])[^A-Za-z0-9%~\r\n]*+[~\r\n][^A-Za-z0-9%]*+", "\n"),
    (r"[^A-Za-z0-9%&\n]+", " "),
)


def sentences(text: Column) -> Column:
    """Lower-case words; ' ' between words, '\\n' at line ends and semicolons, '%' and '&' at other sentence ends."""
    signs = F.translate(F.coalesce(text, F.lit("")), "%~&", "---")
    for pattern, sign in _STEPS:
        signs = F.regexp_replace(signs, pattern, sign)
    return F.lower(F.btrim(signs, F.lit(" %\n")))


def _known_pattern(known: dict[str, str]) -> str:
    """A known sentence between two ends, over any number of lines; a comment or list marker before it belongs to it."""
    each = "|".join(s.replace(" ", f"(?: |{_WRAP})") for s in sorted(known, key=len, reverse=True))
    return f"(?<![^\n%&]){_MARKER}({each})(?![^\n%&])"


def _anchors(known: dict[str, str]) -> list[str]:
    """Strings of which every known sentence holds one at least: of its words of 7 letters or more (else its longest),
    again and again the one that most of the remaining sentences hold. Short words stand in most texts."""
    rest, chosen = [s for s in known if s], []
    while rest:
        longest = {s: max(map(len, s.split())) for s in rest}
        words = sorted({w for s in rest for w in s.split() if len(w) >= min(7, longest[s])})
        chosen.append(max(words, key=lambda w: (sum(w in s for s in rest), len(w))))
        rest = [s for s in rest if chosen[-1] not in s]
    return chosen


def _number_of_sentences(text: Column) -> Column:
    """As many as ``sentences`` parts, for texts without a known sentence, whose words do not matter."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\r\n]|[.!?;][ \t]")
    return F.size(F.filter(parts, lambda p: p.rlike("[A-Za-z0-9]"))).cast("bigint")


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """``doc_id, n_sentences, n_known, sentence_ids, licenses`` for every row of ``docs`` (``doc_id, text``).

    Sentences end at line breaks, empty lines and at . ! ? ; before white space. A known sentence may also be wrapped over
    lines (not over an empty one), hold a semicolon, stand behind comment signs or after a list marker such as ``1.``,
    ``(a)`` or ``*``; it is then one sentence, and its marker is none. The longest known sentence counts.

    ``sentence_ids`` holds the identifiers in text order as ``<id>``, each run of unknown sentences as ``|``.
    ``licenses`` lists the matched licences in the order of the rules, comma-joined, each once; empty without match. A
    rule matches its identifiers one directly after the other. Null texts have no sentences; repeated rows and null
    ids keep their own row. All steps stay inside the row, so no key can be hot.

    A text without any of a few words, one of which is in every known sentence, holds none; its sentences are only counted.
    """
    folded = docs.select("doc_id", "text", F.lower("text").alias("folded"))
    near = F.coalesce(reduce(or_, [F.contains("folded", F.lit(w)) for w in _anchors(known)], F.lit(False)), F.lit(False))
    looked = folded.select("doc_id", "text", F.when(near, F.col("text")).alias("near"))
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # Known sentences are put between '~', so they are the parts at odd places.
    marked = F.regexp_replace(sentences(F.col("near")), _known_pattern(known), "~$1~")
    found = looked.select("doc_id", "text", F.when(F.col("near").isNotNull(), F.split(marked, "~")).alias("parts"))
    unwrapped = lambda s: F.regexp_replace(s, _WRAP, " ")
    ends = lambda s: F.size(F.filter(F.split(s, "[%&\n]"), lambda p: p != ""))
    found = found.select(
        "doc_id",
        "text",
        F.transform(
            "parts",
            lambda s, i: F.when(
                i % 2 == 1,
                F.struct(F.lit(1).alias("n"), F.concat(F.lit("<"), F.try_element_at(table, unwrapped(s)), F.lit(">")).alias("id")),
            ).otherwise(F.struct(ends(s).alias("n"), F.when(F.length(F.btrim(s, F.lit("%&\n"))) > 0, "|").otherwise("").alias("id"))),
        ).alias("parts"),
    )
    found = found.select(
        "doc_id",
        F.when(F.col("parts").isNull(), _number_of_sentences(F.col("text")))
        .otherwise(F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + p["n"]))
        .alias("n_sentences"),
        F.when(F.col("parts").isNull(), 0).otherwise(F.floor((F.size("parts") - 1) / 2)).cast("bigint").alias("n_known"),
        F.array_join(F.col("parts.id"), "").alias("sentence_ids"),
    )
    unknown = F.when(F.col("n_sentences") > 0, "|").otherwise("")
    found = found.withColumn("sentence_ids", F.coalesce("sentence_ids", unknown))
    steps = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{i}>" for i in ids)).alias("ids")) for name, ids in rules]
    )
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("names"))
    matched = F.aggregate(
        steps,
        start,
        lambda acc, rule: F.struct(
            F.replace(acc["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(F.contains(acc["rest"], rule["ids"]), F.array_append(acc["names"], rule["name"]))
            .otherwise(acc["names"])
            .alias("names"),
        ),
        lambda acc: F.array_join(F.array_distinct(acc["names"]), ","),
    )
    return found.withColumn(
        "licenses", F.when(F.col("n_known") > 0, matched).otherwise(F.lit(""))
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    rest, parts, steps = "sentence_ids", [], []
    for k, (name, ids) in enumerate(RULES):
        pattern = "".join(f"<{i}>" for i in ids)
        steps.append(
            f"s{k + 1} AS (SELECT *, replace(r{k}, '{pattern}', '|') AS r{k + 1},"
            f" CASE WHEN contains(r{k}, '{pattern}') THEN ['{name}'] ELSE [] END AS f{k + 1} FROM s{k})"
        )
        parts.append(f"f{k + 1}")
    names = " || ".join(parts)
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
parts AS (
    SELECT doc_id, lower(trim(regexp_replace(p.part, '[^A-Za-z0-9]+', ' ', 'g'))) AS sentence, p.pos
    FROM (
        SELECT doc_id, unnest(list_zip(l, range(len(l)))) AS z
        FROM (
            SELECT doc_id, string_split_regex(
                regexp_replace(coalesce(text, ''), '[.!?;][ \t\r\n]+', chr(10), 'g'), '[\r\n]+') AS l
            FROM documents
        )
    ), LATERAL (SELECT z[1] AS part, z[2] AS pos) p
),
tagged AS (
    SELECT doc_id, p.pos, id FROM (SELECT * FROM parts WHERE sentence <> '') p LEFT JOIN known USING (sentence)
),
per_doc AS (
    SELECT doc_id, count(*) AS n_sentences, count(id) AS n_known,
           string_agg(CASE WHEN id IS NULL THEN '|' ELSE '<' || id || '>' END, '' ORDER BY pos) AS seq
    FROM tagged GROUP BY doc_id
),
s0 AS (
    SELECT doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_known, 0) AS BIGINT) AS n_known,
           regexp_replace(coalesce(seq, ''), '\|+', '|', 'g') AS {rest},
           regexp_replace(coalesce(seq, ''), '\|+', '|', 'g') AS r0
    FROM documents LEFT JOIN per_doc USING (doc_id)
),
{", ".join(steps)}
SELECT doc_id, n_sentences, n_known, {rest},
       array_to_string(list_filter({names}, lambda x, i: list_position({names}, x) = i), ',') AS licenses
FROM s{len(RULES)}
"""


QUERIES = {"op1_license_scan": op1_license_scan}
SQL = {"op1_license_scan": _sql()}
