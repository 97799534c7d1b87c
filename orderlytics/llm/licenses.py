"""Licence lookup by canonical digest.

A text is brought to a canonical form: lines with a copyright statement go,
letters A-Z are lowered, equivalent spellings become one, everything but letters
and digits (of ASCII; also typographic quotes, dashes and bullets) becomes a space,
and spaces are joined. The SHA-256 of that form is
looked up among the digests of known licence texts: of whole documents, by hash
join, and of each single line, which finds notices inside longer documents.

NULL and empty texts, and texts that are nothing but copyright lines, have no
licence. Repeated rows are judged each; no documents give no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import reduce
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlytics.llm.common import ROW, ascii_lower, text_of, wrapped

# Whole licence texts, with their usual variants, and one-line notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, {andor} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND {party} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {party} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{n1} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{n2} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
{third}
THIS SOFTWARE IS PROVIDED BY {givers} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {liable} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = (
    *(
        f"Neither the name of {owner} contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission."
        for owner in (
            "the copyright holder nor the names of its", "the copyright holder nor the names of their",
            "the copyright holders nor the names of its", "the copyright holders nor the names of their",
            "the copyright owner nor the names of its", "the University nor the names of its",
            "the organization nor the names of its", "the <organization> nor the names of its",
            "the author nor the names of its", "the project nor the names of its", "Google Inc. nor the names of its",
            "Google LLC nor the names of its",
        )
    ),
    "The name of the author may not be used to endorse or promote products derived from this software without specific "
    "prior written permission.",
    "The names of its contributors may not be used to endorse or promote products derived from this software without "
    "specific prior written permission.",
)
_PARTIES = (
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "THE COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "<COPYRIGHT HOLDER>"),
    ("THE REGENTS AND CONTRIBUTORS", "THE REGENTS OR CONTRIBUTORS"),
    ("THE AUTHOR AND CONTRIBUTORS", "THE AUTHOR OR CONTRIBUTORS"),
    ("THE AUTHORS AND CONTRIBUTORS", "THE AUTHORS OR CONTRIBUTORS"),
    ("THE AUTHOR", "THE AUTHOR"),
)
_ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor, Boston,? MA\s+02110-1301,?\s+USA"
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA",
    "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)
#: What follows the terms themselves and is often left out.
_AFTER_TERMS = r"(?m)^[ \t]*(?:APPENDIX: How to apply the Apache|(?:Appendix: )?How to Apply These Terms to Your New|Exhibit A - Source|EXHIBIT A -Mozilla)"
_HEADS = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "BSD License"),
    "BSD-3-Clause": (
        "BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License",
        "BSD License",
    ),
}


#: Further SPDX identifiers of a licence, and licences that are known by their notices only.
_SPDX = {
    **{f"{g}-{v}": tuple(f"{g}-{v}{end}" for end in ("", "-only", "-or-later")) for g, v in (
        ("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0"),
    )},
    **{name: (name,) for name in (
        "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "MPL-1.1", "MPL-2.0", "CC0-1.0", "CC-BY-4.0",
        "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    )},
}
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("all-rights-reserved", "All rights reserved."),
    # Whole first paragraphs, which stand on one line where texts are not wrapped.
    ("MIT", _MIT.split("\n")[0]),
    ("ISC", _ISC.format(andor="and/or", party="").split("\n")[0]),
    *((name, f"SPDX-License-Identifier: {i}") for name, ids in _SPDX.items() for i in ids),
)


def _stored(name: str, text: str) -> set[str]:
    """A stored text with and without what follows its terms, with each address of the FSF."""
    found = re.search(_AFTER_TERMS, text)
    made = {text, text[: found.start()]} if found else {text}
    made |= {re.sub(r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", "", t) for t in made}
    made |= {re.sub(r"(?m)^Copyright \[yyyy\].*$", "", t.replace("   Copyright [yyyy]", "Copyright [yyyy]")) for t in made}
    made |= {re.sub(_ADDRESS, a, t) for t in made for a in _ADDRESSES}
    if name == "GPL-2.0":
        made |= {re.sub(r"GNU\s+Lesser\s+General\s+Public\s+License\s+instead", "GNU Library General Public License instead", t) for t in made}
    if name == "CC0-1.0":
        made |= {t.replace("Creative Commons Legal Code", "", 1) for t in made}
    if name.startswith("CC-BY"):  # the legal code alone, without what Creative Commons says of itself
        parts = re.split(r"(?m)^={20,}$", text)
        made |= {parts[-2], f"{parts[0]}\n{parts[-2]}", f"{parts[0]}\n{parts[-2]}\n{parts[-1]}"} if len(parts) > 2 else set()
    return made


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the licences known by their whole texts: those beside this module, and the short ones."""
    made: dict[str, set[str]] = {"MIT": {_MIT}}
    made["ISC"] = {
        _ISC.format(andor=a, party=p)
        for a in ("and/or", "and")
        for p in ("THE AUTHOR", "ISC", "THE COPYRIGHT HOLDER", "INTERNET SYSTEMS CONSORTIUM")
    }
    for name, thirds in (("BSD-2-Clause", ("",)), ("BSD-3-Clause", _THIRD)):
        made[name] = {
            _BSD.format(n1=n[0], n2=n[1], third=f"{n[2]} {third}" if third else "", givers=givers, liable=liable)
            for n in (("", "", ""), ("1.", "2.", "3."))
            for third in thirds
            for givers, liable in _PARTIES
        }
    for file in resources.files("orderlytics.llm.licence_texts").iterdir():
        if file.name.endswith(".txt"):
            name = file.name.removesuffix(".txt").split("~")[0]
            made.setdefault(name, set()).update(_stored(name, file.read_text("utf-8")))
    out = []
    for name, texts in made.items():
        heads = ["", *_HEADS.get(name, ()), *(f"SPDX-License-Identifier: {i}" for i in _SPDX[name])]
        if name in _HEADS:
            heads += [f"{h}\nAll rights reserved." for h in heads]
        out += [(name, f"{h}\n{t}") for h in heads for t in sorted(texts)]
    return out


#: One spelling for each group of equivalent ones (over the lowered text, as expressions).
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("merchantibility", "merchantability"),
    ("non-infringement", "noninfringement"),
    ("organisation", "organization"),
    ("https:", "http:"),
)
COPYRIGHT_LINE = r"(?m)^[^\n]*(?:copyright \(c\)|copyright ©|copyright [0-9]|\(c\) [0-9]|© ?[0-9])[^\n]*$"


def canonical(text: Column) -> Column:
    lowered = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "")
    same = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, lowered)
    return F.trim(F.regexp_replace(same, r"[\x00-\x2F\x3A-\x60\x7B-\x7F\u00A0\u2010-\u2027\uFEFF]+", " "))


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, text): the whole texts and the notices."""
    return spark.createDataFrame([*whole_texts(), *NOTICES], "license string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license, size of the form); of licences with equal forms the first by name."""
    forms = known.select("license", canonical(F.col("text")).alias("form")).where("form <> ''")
    return forms.groupBy(F.sha2("form", 256).alias("digest")).agg(
        F.min("license").alias("license"), F.max(F.octet_length("form")).alias("size")
    )


def _lookup(table: dict[str, str]) -> Callable[[Column], Column]:
    """License of a digest. The map is cut by the first two digits, as Spark walks through a map's keys."""
    parts: list[dict[str, str]] = [{} for _ in range(256)]
    for key, name in table.items():
        parts[int(key[:2], 16)][key] = name
    cut = F.from_json(F.lit(json.dumps(parts)), "array<map<string,string>>")
    return lambda key: F.try_element_at(F.get(cut, F.conv(F.substring(key, 1, 2), 16, 10).cast("int")), key)


def scanned(docs: DataFrame, known: DataFrame | None = None, text: str = "text") -> DataFrame:
    """Rows (wrapped) with `license` of the whole text and `notices`, the licences of its lines.

    `known` is a table (license, text) of licences, by default `known_texts`. Its
    digests go to all tasks; documents are read once and not shuffled.
    """
    spark = docs.sparkSession
    table = known_digests(known_texts(spark) if known is None else known).collect()
    digests = spark.createDataFrame([(r.digest, r.license) for r in table], "digest string, license string")
    body = text_of(text)
    # Only lines whose form is as long as a known one need a digest. Each transform binds its argument once.
    forms = F.transform(F.split(body, "\n", -1), canonical)
    sizes = sorted({r.size for r in table})
    forms = F.filter(forms, lambda form: F.octet_length(form).isin(sizes))
    found = F.transform(F.transform(forms, lambda form: F.sha2(form, 256)), _lookup({r.digest: r.license for r in table}))
    notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    rows = docs.select(wrapped(docs), digest(body).alias("digest"), notices.alias("notices"))
    return rows.join(F.broadcast(digests), "digest", "left").select(ROW, "digest", "license", "notices")
