"""Canonical digest lookup of licences: whole texts, brought to one form, joined to known digests.

The form folds ASCII case, drops lines that name a copyright holder, takes punctuation and white space as one space and
writes equivalent spellings alike; its SHA-256 is looked up. All of it is built-in column functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines that name a holder, not a condition: those with a sign or year anywhere, those without at the start of a paragraph.
#: A wrapped condition may begin a line with the word, too.
HOLDERS = (
    r"(^|\n[ \t\r]*\n)([ \t]*copyright[ \t]+(?!(holder|owner|notice|law|license|licence|statement|interest|and|or|in|is|are|of|on)s?\b)[^\n]+(\n|$))+",
    r"(^|\n)[ \t]*(copyright[ \t:]*(\(c\)|©|[12][0-9]{3}|[\[<{](year|yyyy))|(\(c\)|©)[ \t]*(copyright|[12][0-9]{3})|©|all rights reserved[ \t\r.]*(\n|$))[^\n]*",
)
#: Characters taken as white space: ASCII controls and punctuation, no-break space, dashes, quotes, bullet, ellipsis.
PUNCTUATION = "\t\n\v\f\r!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ ‐‑‒–—‘’“”•…"
#: Spellings taken as equal, the second for the first, in this order.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("copyright holder", "copyright owner"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("merchantibility", "merchantability"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Texts of known licences and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
KNOWN = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        + _AS_IS
        + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
        + _AS_IS
        + " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n"
        + _AS_IS
        + " AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("MIT-notice", "Released under the MIT License."),
    ("Apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0-notice", "Licensed under CC BY-NC 4.0."),
)


TEXTS = Path(__file__).parent / "licence_texts"
_FRANKLIN = re.compile(r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,?\s+MA\s+02110-1301,?\s+USA")
_ADDRESSES = ("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA")
# Headings of short texts, by the start of the id; the canonical form takes case and punctuation away.
_HEADINGS = {
    "MIT": ("MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT", "License: MIT", "License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC", "License"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD", "License"),
    "BSD-2": ("BSD 2-Clause License", "The BSD 2-Clause License", "Simplified BSD License", "BSD License", "License"),
    "BSD-3": ("BSD 3-Clause License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License", "License"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng license", "License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
# Where the body of a longer text begins and, if less than the whole is common, ends.
_BODIES = {
    "Apache-2.0": ("TERMS AND CONDITIONS FOR USE", ("APPENDIX: How to apply", "END OF TERMS")),
    "CC0-1.0": ("CC0 1.0 Universal", ()),
    "MPL-2.0": ("1. Definitions", ()),
    "GPL": ("Everyone is permitted", ("How to Apply These", "END OF TERMS")),
    "LGPL": ("Everyone is permitted", ("How to Apply These", "END OF TERMS")),
}


def _forms(name: str, text: str) -> Iterator[str]:
    """The text, and the same with a part that copies often lack left out or in another usual wording."""
    start, ends = next((v for k, v in _BODIES.items() if name.startswith(k)), ("", ()))
    # What follows a last title such as "Appendix:" is left out with it.
    cut = [text, *(re.sub(r"\s*Appendix:\s*$", "", text[: text.index(e)]) for e in ends if e in text)]
    for whole in cut:
        yield whole
        if start:
            yield whole[whole.index(start) :]
    if name == "CC0-1.0":
        yield text[: text.index("CREATIVE COMMONS CORPORATION")] + text[text.index("Statement of Purpose") :]
        yield text[text.index("Statement of Purpose") :]
    if name.startswith(("GPL", "LGPL", "GFDL")) and _FRANKLIN.search(text):
        for whole in cut:
            for address in _ADDRESSES:
                yield _FRANKLIN.sub(address, whole)
                yield _FRANKLIN.sub(address, _FRANKLIN.sub("", whole, count=1))


def _bsd(regents: str) -> Iterator[tuple[str, str]]:
    """The forms of the BSD licences of two and three clauses, from that of the Regents."""
    third = regents[regents.index("3. Neither") : regents.index("THIS SOFTWARE")]
    tails = (("REGENTS", "REGENTS"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDER"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("AUTHOR", "AUTHOR"), ("AUTHORS", "AUTHORS"))
    for provided, liable in tails:
        text = regents.replace("BY THE REGENTS", f"BY THE {provided}").replace("SHALL THE REGENTS", f"SHALL THE {liable}")
        for name in ("the University", "the copyright holder", "the copyright holders", "the author", "the authors", None):
            one = text.replace(third, "" if name is None else third.replace("the University", name) + "\n")
            for marked in (one, re.sub(r"(?m)^[123]\. ", "* ", one)):
                yield "BSD-2-Clause" if name is None else "BSD-3-Clause", marked


def further_texts() -> Iterator[tuple[str, str]]:
    """(license_id, text) of whole licences in their usual forms, those of :data:`KNOWN` with headings among them."""
    short = [(k, v) for k, v in KNOWN if k in _HEADINGS]
    short += [(k, v.replace("and/or distribute", "and distribute")) for k, v in short if k == "ISC"]
    short += [(k, v.replace("AND THE AUTHOR DIS", "AND ISC DIS").replace("SHALL THE AUTHOR", "SHALL ISC")) for k, v in short if k == "ISC"]
    for path in sorted(TEXTS.glob("*.txt")):
        name, text = path.stem, path.read_text(encoding="utf-8")
        if name == "BSD-3-Clause":
            short += _bsd(text)
        elif name in _HEADINGS:
            short.append((name, text))
        else:
            yield from ((name, form) for form in dict.fromkeys(_forms(name, text)))
    for name, text in short:
        yield name, text
        for heading in next(v for k, v in _HEADINGS.items() if name.startswith(k)):
            yield name, f"{heading}\n\n{text}"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null is the empty form."""
    x = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    for lines in HOLDERS:
        x = F.regexp_replace(x, lines, "\n\n")
    x = F.trim(F.regexp_replace(F.translate(x, PUNCTUATION, " " * len(PUNCTUATION)), " +", " "))
    # Few texts hold a spelling to replace; one search tells.
    any_of = r"\b(" + "|".join(a for a, _ in SPELLINGS) + r")"
    spelt = x
    for a, b in SPELLINGS:
        spelt = F.regexp_replace(spelt, rf"\b{a}(s?)\b", f"{b}$1")
    return F.when(x.rlike(any_of), spelt).otherwise(x)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_licences(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the licences that come with the operator; any table of that form will do."""
    return spark.createDataFrame([*KNOWN, *further_texts()], "license_id string, text string")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, license_id (null if unknown) for every row of ``docs``.

    A document is a licence if its whole text has the canonical form of a known one. If several known ones
    share a form, the least license_id stands for it. Texts whose form is empty, null ones among them, are
    never licences. Null ids and repeated rows are kept; an empty table gives none; other columns are
    ignored. Spark broadcasts the digests while it measures them below its threshold, and shuffles else.
    """
    known = known_licences(docs.sparkSession) if known is None else known
    table = known.select(digest(F.col("text")).alias("known_digest"), F.col("license_id").cast("string").alias("license_id"), (canonical(F.col("text")) != "").alias("told"))
    table = table.where("told").groupBy("known_digest").agg(F.min("license_id").alias("license_id"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("digest"))
    return rows.join(table, F.col("digest") == F.col("known_digest"), "left").select("doc_id", "digest", "license_id")
