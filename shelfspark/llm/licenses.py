"""Licence scans: a paragraph classifier over word n-grams, a calibrated unknown class, templates that confirm.

A paragraph is the lines between blank lines, joined, so a wrapped notice is read like an unwrapped one; a long one is read
in windows of `WINDOW` words that overlap by `OVERLAP`, which is more than `CONFIRM` of the longest template.
Features are the words and word pairs of a window that are among the `FEATURES` most frequent of the training rows, as a
sparse vector. A multinomial logistic regression tells the licence families and the unknown class apart; a second one of
one variable, fitted on rows the first hasn't seen, turns its odds of a licence into a calibrated probability, and under
one half a window is unknown. Else every family that is likelier than the unknown class is predicted, so a line may name
several. A prediction is confirmed if the window holds enough of the three-word shingles of one of the family's templates,
and enough of those that no other family's templates have: CC BY-SA is no CC BY, the Lesser GPL no GPL.

Training rows are the templates, the templates with one word left out, templates with corpus words before, after and
around them, pairs of templates of two families (under the first), and corpus windows, which count as unknown unless they
confirm a family. The corpus windows come from a sample of `SAMPLE` documents, the ones with the smallest hashes, and are
`LINES` at most.

DataFrame functions and Spark's own estimators only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, stored, table

WINDOW = 144
OVERLAP = 60
FEATURES = 4096
SAMPLE = 1000
LINES = 4000
CONFIRM = 0.6
#: The part of a template's own shingles that must be there.
CONFIRM_OWN = 0.5
UNKNOWN = "unknown"

# Notices of well-known licences by family, paragraph by paragraph, and the short forms in use.
TEMPLATES = {
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL v3.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Distributed under the Apache 2.0 license.",
        "This software is available under the Apache License 2.0.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
        "Licensed under the 3-Clause BSD License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released into the public domain under CC0 1.0.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "Released under the GNU General Public License v2.",
        "Released under the terms of the GNU GPL v3.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
        "Released under the ISC License.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the GNU LGPL v3.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
}
CLASSES = (*TEMPLATES, UNKNOWN)


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters, digits, dots and hyphens within, without dots at the end."""
    return F.array_remove(F.split(F.lower(text), r"(?:[.-]*(?:[^\p{L}\p{N}.-]+|$))"), "")


def _triples(words: Column) -> Column:
    """Distinct three-word shingles; all words together if there are fewer."""
    last = F.greatest(F.size(words) - 3, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, 3), " ")))


def _templates(spark: SparkSession) -> DataFrame:
    """(number, family, words) of every template; the table is as long as the list above."""
    rows = [F.struct(F.lit(i).alias("number"), F.lit(f).alias("family"), F.lit(t).alias("text")) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    return spark.range(1).select(F.inline(F.array(*rows))).select("number", "family", word_array(F.col("text")).alias("words"))


def _template_shingles(spark: SparkSession) -> dict[str, list[tuple[list[str], list[str]]]]:
    """(all shingles, those no other family's templates have) of each family's templates, as the words of documents are cut."""
    rows = _templates(spark).select("family", _triples(F.col("words")).alias("triples")).collect()
    known: dict[str, list[tuple[list[str], list[str]]]] = {f: [] for f in TEMPLATES}
    for r in rows:
        others = {t for x in rows if x.family != r.family for t in x.triples}
        known[r.family].append((r.triples, [t for t in r.triples if t not in others]))
    return known


def _share(triples: Column, wanted: list[str]) -> Column:
    """The part of the wanted shingles that there are."""
    return F.size(F.array_intersect(triples, F.split(F.lit("|".join(wanted)), "[|]"))) / F.lit(len(wanted))


def _confirms(triples: Column, templates: list[tuple[list[str], list[str]]]) -> Column:
    """Whether enough of a template and of its own shingles is there; not without triples."""
    fits = [(_share(triples, every) >= CONFIRM) & (_share(triples, own) >= CONFIRM_OWN) for every, own in templates if own]
    return F.coalesce(reduce(lambda a, b: a | b, fits), F.lit(False))


def windows(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep`, line, window and words of every window; line counts paragraphs. Of paragraphs without words only a text's first has one, an empty one."""
    plain = F.regexp_replace("text", r"\r\n?", "\n")
    lines = docs.select(*keep, F.posexplode(F.split(plain, r"\n[\x20\t\x0B\f]*\n\s*")).alias("line", "_text"))
    lines = lines.withColumn("_words", word_array(F.col("_text"))).where((F.size("_words") > 0) | (F.col("line") == 0))
    step = WINDOW - OVERLAP
    count = F.greatest(F.ceil((F.size("_words") - OVERLAP) / step), F.lit(1)).cast("int")
    spread = lines.withColumn("window", F.explode(F.sequence(F.lit(0), count - 1)))
    return spread.withColumn("words", F.slice("_words", F.col("window") * step + 1, WINDOW)).drop("_text", "_words")


def _with_terms(rows: DataFrame) -> DataFrame:
    paired = NGram(n=2, inputCol="words", outputCol="_pairs").transform(rows)
    return paired.withColumn("_terms", F.concat("words", "_pairs")).drop("_pairs")


def _odds(probability: Column) -> Column:
    """Log odds of any licence at all."""
    unknown = F.greatest(F.least(F.get(vector_to_array(probability), F.lit(len(CLASSES) - 1)), F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log((1 - unknown) / unknown)


def sample_texts(docs: DataFrame) -> DataFrame:
    """(text) of the SAMPLE documents with the smallest hashes, each text once. Hashes are sorted, not texts."""
    named = docs.where("text is not null").select(F.xxhash64("text").alias("_hash"), "text")
    chosen = stored(named.select("_hash").distinct().orderBy("_hash").limit(SAMPLE), "chosen")
    return named.join(F.broadcast(chosen), "_hash").groupBy("_hash").agg(F.min("text").alias("text")).select("text")


def training_rows(docs: DataFrame) -> DataFrame:
    """(words, label) as described above; label is the number of the class."""
    spark = docs.sparkSession
    lines = windows(sample_texts(docs), []).select("words").where(F.size("words") > 0).distinct().orderBy(F.xxhash64("words")).limit(LINES)
    lines = stored(lines, "lines")
    families = list(TEMPLATES)
    templates = stored(_templates(spark), "templates")
    number = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("family")) - 1
    one_less = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.concat(F.slice("words", F.lit(1), i - 1), F.slice("words", i + 1, WINDOW)))
    short = templates.select(F.explode(one_less).alias("words"), number.alias("label"))
    count = templates.count()
    dealt = lines.select(F.pmod(F.xxhash64("words"), F.lit(count)).cast("int").alias("number"), F.slice("words", 1, 60).alias("around"), F.slice("words", 61, 60).alias("beyond"))
    around = templates.join(dealt, "number")
    before = around.select(F.concat("around", "words").alias("words"), number.alias("label"))
    after = around.select(F.concat("words", "around").alias("words"), number.alias("label"))
    inside = around.select(F.concat("around", "words", "beyond").alias("words"), number.alias("label"))
    second = templates.select(F.pmod(F.col("number") - 7, F.lit(count)).alias("number"), F.col("words").alias("other"))
    both = templates.join(second, "number").select(F.concat("words", "other").alias("words"), number.alias("label"))
    known = _template_shingles(spark)
    triples = _triples(F.col("words"))
    confirmed = F.array_compact(F.array(*(F.when(_confirms(F.col("triples"), known[f]), F.lit(i)) for i, f in enumerate(families))))
    own = lines.select("words", triples.alias("triples")).select("words", F.coalesce(F.get(confirmed, F.lit(0)), F.lit(len(families))).alias("label"))
    return reduce(DataFrame.union, [templates.select("words", number.alias("label")), short, before, after, inside, both, own])


class LicenceModel:
    """The vocabulary, the classifier and its calibration."""

    def __init__(self, terms: CountVectorizerModel, classes: LogisticRegressionModel, known: LogisticRegressionModel) -> None:
        self.terms, self.classes, self.known = terms, classes, known

    @classmethod
    def fit(cls, docs: DataFrame) -> LicenceModel:
        rows = training_rows(docs).withColumn("label", F.col("label").cast("double"))
        rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("words"), F.lit(3))).orderBy(F.xxhash64("words"), "label").coalesce(4), "training")
        # every class must be known to the first model: a row of weight 0 stands for what a fold lacks
        classes = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial", standardization=False)
        every = rows.sparkSession.range(len(CLASSES)).select(F.array(F.lit("")).alias("words"), F.col("id").cast("double").alias("label"), F.lit(0.0).alias("weight"))
        taught = _with_terms(rows.where("fold <> 0").select("words", "label", F.lit(1.0).alias("weight")).union(every))
        terms = CountVectorizer(vocabSize=FEATURES, binary=True, inputCol="_terms", outputCol="features").fit(taught)
        model = classes.setWeightCol("weight").fit(terms.transform(taught))
        held = model.transform(terms.transform(_with_terms(rows.where("fold = 0")))).select(
            array_to_vector(F.array(_odds(F.col("probability")))).alias("features"), (F.col("label") < len(CLASSES) - 1).cast("double").alias("label")
        )
        # on rows that are told apart without error the slope would grow without end; the penalty bounds it
        return cls(terms, model, LogisticRegression(maxIter=60, regParam=1e-2, standardization=False).fit(held))

    def predicted(self, rows: DataFrame) -> DataFrame:
        """`rows` (with words), probability, families (predicted) and confirmed (those of them)."""
        templates = _template_shingles(rows.sparkSession)
        slope, base = float(self.known.coefficients[0]), float(self.known.intercept)
        scored = self.classes.transform(self.terms.transform(_with_terms(rows))).drop("_terms", "features", "rawPrediction", "prediction")
        known = scored.withColumn("_each", vector_to_array("probability")).withColumn("_odds", _odds(F.col("probability"))).drop("probability")
        known = known.withColumn("probability", 1 / (1 + F.exp(-(F.lit(slope) * F.col("_odds") + F.lit(base)))))
        licensed = (F.col("probability") >= 0.5) & (F.size("words") > 0)
        names = F.split(F.lit("|".join(TEMPLATES)), "[|]")
        likelier = F.filter(names, lambda f: F.get("_each", (F.array_position(names, f) - 1).cast("int")) >= F.get("_each", F.lit(len(TEMPLATES))))
        known = known.withColumn("families", F.when(licensed, likelier).otherwise(F.array().cast("array<string>")))
        known = known.withColumn("_triples", F.when(F.size("families") > 0, _triples(F.col("words"))))
        confirmed = [F.when(F.array_contains("families", f) & _confirms(F.col("_triples"), t), F.lit(f)) for f, t in templates.items()]
        return known.withColumn("confirmed", F.when(F.size("families") > 0, F.array_compact(F.array(*confirmed))).otherwise(F.array().cast("array<string>"))).drop("_each", "_odds", "_triples")


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """(doc_id, windows, licences, found, confirmed, probability) of every row of documents.

    licences: the confirmed families, sorted and joined with commas, empty if there are none; found and confirmed count
    windows with predicted and with confirmed families, probability is the highest of any window, 0 without words. Null
    and empty texts have no windows. Repeated rows stay.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.coalesce("text", F.lit("")).alias("text"))
    found = model.predicted(windows(rows, ["doc_id", "rid"]))
    each = found.groupBy("doc_id", "rid").agg(
        F.count_if(F.size("words") > 0).alias("windows"),
        F.array_distinct(F.flatten(F.collect_set("confirmed"))).alias("licences"),
        F.count_if(F.size("families") > 0).alias("found"),
        F.count_if(F.size("confirmed") > 0).alias("confirmed"),
        F.coalesce(F.max(F.when(F.size("words") > 0, F.round("probability", 6))), F.lit(0.0)).alias("probability"),
    )
    return each.select("doc_id", "windows", F.array_join(F.array_sort("licences"), ",").alias("licences"), "found", "confirmed", "probability")


def op4_license_scan(spark, sf_dir):
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    return scan(docs, LicenceModel.fit(docs))
