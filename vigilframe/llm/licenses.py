"""License scans: TF-IDF cosine of texts to licence templates, and inheritance from the nearest directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import let, query, stage, table

MIN_COSINE = 0.8
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
TERM = r"[\p{L}\p{N}]+(?:\.[\p{N}]+)*"
#: (licence, text): headers, notices and licence texts that files are compared with.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("BSD-3-Clause", "Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
]


def terms(text: Column) -> Column:
    """Distinct words of letters, digits and inner dots in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))


def template_table(spark, templates=TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, text string")


def text_units(text: Column, vocabulary: list[str], least: float) -> Column:
    """What is compared of a text, as an array of (t: distinct terms, most: has it more than half of the lines with terms).

    The units are each line, the whole text, and blocks of consecutive lines: paragraphs (up to a line
    without terms), and runs of lines of which at least the share ``least`` of the terms is in
    ``vocabulary``, once up to a line without terms and once over those, so that a wrapped header is found
    above code and a licence of several paragraphs below a title.
    """
    def of(ls: Column) -> Column:
        empty = lambda x: F.size(x.t) == 0
        strange = lambda x: ~empty(x) & ~x.near
        filled = F.filter(ls, lambda x: ~empty(x))
        unit = lambda t, lines: F.struct(t.alias("t"), (lines * 2 > F.size(filled)).alias("most"))

        def blocks(stop) -> Column:
            """Blocks between the lines at which ``stop`` is true."""
            at = F.concat(F.filter(F.transform(ls, lambda x, i: F.when(stop(x), i).otherwise(F.lit(-1))), lambda i: i >= 0), F.array(F.size(ls)))

            def cut(ends: Column) -> Column:
                begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(ends, F.greatest(j - 1, F.lit(0))) + 1)
                return F.transform(ends, lambda e, j: F.filter(F.slice(ls, begin(j) + 1, F.greatest(e - begin(j), F.lit(0))), lambda x: ~empty(x)))

            return F.filter(let(at, cut), lambda b: F.size(b) > 1)

        runs = F.concat(
            blocks(empty), blocks(lambda x: empty(x) | strange(x)), blocks(strange), blocks(lambda x: F.lit(False))
        )
        together = lambda b: F.array_distinct(F.flatten(F.transform(b, lambda x: x.t)))
        return F.concat(
            F.transform(filled, lambda x: unit(x.t, F.lit(1))), F.transform(runs, lambda b: unit(together(b), F.size(b)))
        )

    def line(t: Column) -> Column:
        known = F.size(F.filter(t, lambda w: w.isin(vocabulary)))
        return F.struct(t.alias("t"), ((F.size(t) > 0) & (known >= F.size(t) * least - 1e-9)).alias("near"))

    return let(F.transform(F.split(text, "\n"), lambda x: let(terms(x), line)), of)


def license_matches(files: DataFrame, templates: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(path, license, cosine, most): the best match of each file that has one of ``min_cosine`` or more.

    Each line, each block of consecutive lines and the whole of every file are compared (`text_units`).
    ``most``: whether a unit that matches has more than half of the text's lines with terms.
    Vectors hold every distinct word with its inverse document frequency over all lines of all files, and
    over the whole of files named as licence files; words of no template get the largest weight, so a unit can only match if at least the square of ``min_cosine`` of its words
    are template words.  Only those units are taken apart into rows.
    """
    vocabulary = sorted({t for row in templates.select(terms(F.col("text")).alias("t")).collect() for t in row.t})
    least = min_cosine * min_cosine
    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.rlike("path", F.lit(LICENSE_FILE)), F.array(text)).otherwise(F.array().cast("array<string>"))
    known = F.filter("t", lambda w: w.isin(vocabulary))
    lines = files.select(F.explode(F.concat(F.split(text, "\n"), whole)).alias("unit")).select(terms(F.col("unit")).alias("t"))
    lines = lines.where(F.size("t") > 0).withColumn("k", known)
    units = files.select("path", F.explode(text_units(text, vocabulary, least)).alias("u")).select("path", "u.*").withColumn("k", known)
    # The table of frequencies is as long as the templates' vocabulary.
    counted = stage(
        lines.select(F.explode(F.concat(F.array(F.lit("")), "k")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")),
        "term-counts",
    )
    total = counted.where("term = ''").agg(F.max("df")).first()[0] or 0
    idf = lambda df: F.log((F.lit(total) + 1.0) / (df + 1.0)) + 1.0
    words = templates.sparkSession.createDataFrame([(w,) for w in vocabulary], "term string")
    weights = words.join(counted, "term", "left").select("term", idf(F.coalesce("df", F.lit(0))).alias("w"))
    parts = (
        templates.select("template", "license", F.explode(terms(F.col("text"))).alias("term")).join(weights, "term")
    )
    norms = parts.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    parts = F.broadcast(parts.join(norms, "template").groupBy("term").agg(
        F.first("w").alias("w"), F.collect_list(F.struct("template", "license", "norm")).alias("in")
    ))  # one row for each word of the templates
    near = units.where(F.size("k") >= F.size("t") * least - 1e-9).select(
        "path", F.xxhash64(F.array_sort("t")).alias("unit"), (F.size("t") - F.size("k")).alias("others"), F.array_sort("k").alias("k"), "most"
    )
    near = near.groupBy("path", "unit", "others", "k").agg(F.max("most").alias("most"))
    rows = near.select("path", "unit", "others", "most", F.explode("k").alias("term")).join(parts, "term")
    scores = (
        rows.groupBy("path", "unit", "others", "most")
        .agg(F.sum(F.col("w") * F.col("w")).alias("square"), F.collect_list(F.struct("w", "in")).alias("terms"))
        .select(
            "path", (F.col("square") + F.col("others") * idf(F.lit(0)) * idf(F.lit(0))).alias("square"), F.explode("terms").alias("x"), "unit", "most",
        )
        .select("path", "unit", "most", "square", (F.col("x.w") * F.col("x.w")).alias("ww"), F.explode("x.in").alias("m"))
        .groupBy("path", "unit", "most", "square", "m")
        .agg(F.sum("ww").alias("dot"))
        .select("path", "most", F.col("m.template").alias("template"), F.col("m.license").alias("license"), F.round(F.col("dot") / (F.sqrt("square") * F.col("m.norm")), 9).alias("cosine"))
        .where(F.col("cosine") >= min_cosine)
    )
    return (
        scores.groupBy("path").agg(F.max(F.struct("cosine", -F.col("template"), "license")).alias("best"), F.max("most").alias("most"))
        .select("path", "best.license", "best.cosine", "most")
    )


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """A directory and all above it, nearest first, as (directory, depth); the root is the empty path."""
    return let(
        F.split(directory, "/"),
        lambda ps: F.transform(
            F.sequence(F.lit(1), F.size(ps)), lambda n: F.struct(F.array_join(F.slice(ps, 1, n), "/").alias("ancestor"), n.alias("depth"))
        ),
    )


def scan_licenses(
    files: DataFrame, templates: DataFrame, is_license: Column | None = None, min_cosine: float = MIN_COSINE
) -> DataFrame:
    """(path, license, origin, cosine) for every distinct path of ``files`` (path, text).

    ``origin``: own, directory (inherited) or null.  A file without a match of its own inherits from the
    nearest directory at or above its own that holds a licence file: a matched file of which
    ``is_license`` (by default, its name; also of ``most``, see `license_matches`) is true; of several the first path counts.  Directories are joined
    with their ancestors once each, however many files they hold.  Null text: no match.  Rows with a null
    path are left out; rows with the same path are one file.  An empty table gives an empty result.
    """
    files = files.where(F.col("path").isNotNull())
    own = stage(license_matches(files, templates, min_cosine), "licenses")
    named = F.rlike("path", F.lit(LICENSE_FILE)) if is_license is None else is_license
    held = own.where(named).groupBy(parent(F.col("path")).alias("ancestor")).agg(F.min(F.struct("path", "license")).alias("held"))
    every = files.select("path").distinct().withColumn("directory", parent(F.col("path")))
    nearest = (
        every.select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("a"))
        .select("directory", "a.ancestor", "a.depth").join(held, "ancestor")
        .groupBy("directory").agg(F.max(F.struct("depth", F.col("held.license").alias("license"))).alias("up"))
        .select("directory", F.col("up.license").alias("inherited"))
    )
    return (
        every.join(own, "path", "left").join(nearest, "directory", "left")
        .select(
            "path", F.coalesce("license", "inherited").alias("license"),
            F.when(F.col("license").isNotNull(), "own").when(F.col("inherited").isNotNull(), "directory").alias("origin"), "cosine",
        )
    )


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: /source/language/thousands of the number/number."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    thousand = F.coalesce(F.floor(F.col("doc_id") / 1000).cast("string"), F.lit("none"))
    return documents.select(
        F.concat(F.lit("/"), part("source"), F.lit("/"), part("lang"), F.lit("/"), thousand, F.lit("/"), part("doc_id")).alias("path"), "text"
    )


@query("op6_license_scan")
def op6_license_scan(spark, sf_dir):
    """Documents have no file names: those of which a licence is most of the text are the licence files."""
    files = document_files(table(spark, sf_dir, "documents"))
    found = scan_licenses(files, template_table(spark), is_license=F.col("most"))
    return found.select(F.regexp_extract("path", r"[^/]*$", 0).try_cast("bigint").alias("doc_id"), "path", "license", "origin", "cosine")
