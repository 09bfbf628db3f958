"""Queries of this subpackage by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks", "text_hash")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), digest=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import filter_urls, sample_entries, sample_times

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(sample_times(pages), sample_entries(pages))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lmscore import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_language

    return identify_language(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc": op4_warc,
    "op5_url_filters": op5_url_filters,
    "op6_lm_score": op6_lm_score,
    "op7_language_id": op7_language_id,
    "op8_decontamination": op8_decontamination,
    "op9_license_scan": op9_license_scan,
    "op10_minhash_near_dup": op10_minhash_near_dup,
}

_W = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '{_W}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
""",
    "op3_mix_sources": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, [5.0, 2.0, 1.0][place % 3 + 1]::DOUBLE AS weight, (sum(source_size) OVER ())::DOUBLE * 1.5 AS budget FROM s),
o AS (SELECT *, cap / weight AS ratio FROM r),
l AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (SELECT ratio AS r0, place AS p0, level AS l0 FROM l WHERE level < ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN r0 IS NULL OR (ratio, place) < (r0, p0) THEN cap ELSE weight * l0 END AS target FROM l LEFT JOIN f ON true),
p AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + greatest(0, least(size, floor(target)::BIGINT - whole * source_size - start)))::BIGINT AS taken FROM p
""",
    "op4_warc": """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM d),
e AS (SELECT page_id, n, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(x, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1) FOR i IN range(32)], '') AS payload_digest FROM h),
m AS (SELECT payload_digest, n, max(page_id) AS top FROM e GROUP BY ALL)
SELECT page_id, n::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to, 1::BIGINT AS n_requests, 1::BIGINT AS n_metadata
FROM e JOIN m USING (payload_digest, n)
""",
    "op5_url_filters": r"""
WITH u AS (SELECT page_id, url, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.'), '') AS host,
  make_timestamp((1704067200 + (page_id * 7919 % 366) * 86400 + page_id % 86400) * 1000000) AS t FROM pages),
k AS (SELECT page_id, host, t, unnest(list_distinct(list_concat(
    [array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') FOR i IN range(1, len(string_split(host, '.')) + 1)],
    [host || '/' || array_to_string(list_slice(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), 1, i), '/')
      FOR i IN range(1, len(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) + 1)]))) AS key FROM u WHERE host IS NOT NULL),
p AS (SELECT DISTINCT unnest([host, CASE WHEN step <> '' THEN host || '/' || step END]) AS pattern FROM (SELECT host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1) AS step FROM u WHERE host IS NOT NULL)),
c AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT AS crc FROM p WHERE pattern IS NOT NULL),
e AS (SELECT CASE WHEN crc % 2 = 0 THEN 'spam' ELSE 'adult' END AS list_name, pattern, unnest(CASE WHEN crc % 3 = 0 THEN [crc % 200, crc % 200 + 100] ELSE [crc % 200] END) AS d, crc % 200 + 20 + crc % 50 AS off FROM c WHERE crc % 4 <> 0),
i AS (SELECT list_name, pattern, make_timestamp((1704067200 + d * 86400) * 1000000) AS a, CASE WHEN d < off THEN make_timestamp((1704067200 + off * 86400) * 1000000) END AS z FROM e),
h AS (SELECT k.page_id, i.list_name, i.pattern, i.a FROM k JOIN i ON k.key = i.pattern AND i.a <= k.t AND (i.z IS NULL OR k.t < i.z))
SELECT u.page_id, u.host, count(h.page_id) > 0 AS blocked, count(h.page_id) AS n_hits, arg_min(h.list_name, (h.list_name, h.pattern, h.a)) AS list_name,
  arg_min(h.pattern, (h.list_name, h.pattern, h.a)) AS pattern, arg_min(h.a, (h.list_name, h.pattern, h.a)) AS listed_at
FROM u LEFT JOIN h USING (page_id) GROUP BY u.page_id, u.host
""",
}


#: Literal pieces, rules and splits, apart from the operator's own.
_LICENSE_PIECES = """
  (0, 'released under the mit license'),
  (1, 'licensed under the apache license version 2 0'),
  (2, 'licensed under cc by nc 4 0'),
  (3, 'this work is licensed under the gnu general public license version 3'),
  (4, 'permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions'),
  (5, 'the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software'),
  (6, 'the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement'),
  (7, 'in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software'),
  (8, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies'),
  (9, 'permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted'),
  (10, 'the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
  (11, 'this software is provided as is without any express or implied warranty'),
  (12, 'in no event will the authors be held liable for any damages arising from the use of this software'),
  (13, 'permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions'),
  (14, 'licensed under the apache license version 2 0 the license'),
  (15, 'you may not use this file except in compliance with the license'),
  (16, 'you may obtain a copy of the license at http www apache org licenses license 2 0'),
  (17, 'see the license for the specific language governing permissions and limitations under the license'),
  (18, 'unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied'),
  (19, 'if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0'),
  (20, 'distributed under the boost software license version 1 0'),
  (21, 'this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0'),
  (22, 'this is free and unencumbered software released into the public domain'),
  (23, 'anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means'),
  (24, 'this program is free software'),
  (25, 'you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
  (26, 'this program is distributed in the hope that it will be useful but without any warranty'),
  (27, 'without even the implied warranty of merchantability or fitness for a particular purpose'),
  (28, 'see the gnu general public license for more details'),
  (29, 'you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation'),
  (30, 'either version 2 of the license or at your option any later version'),
  (31, 'you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation'),
  (32, 'this library is free software'),
  (33, 'you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation'),
  (34, 'either version 2 1 of the license or at your option any later version'),
  (35, 'you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
  (36, 'you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version'),
  (37, 'redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met'),
  (38, 'redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer'),
  (39, 'redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution'),
  (40, 'neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission'),
  (41, 'this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed'),
  (42, 'this work is licensed under a creative commons attribution 4 0 international license'),
  (43, 'this work is licensed under a creative commons attribution sharealike 4 0 international license'),
  (44, 'this work is licensed under a creative commons attribution noncommercial 4 0 international license'),
  (45, 'this work is licensed under a creative commons attribution noderivatives 4 0 international license'),
  (46, 'this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license'),
  (47, 'this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license'),
  (48, 'to the extent possible under law the author has waived all copyright and related or neighboring rights to this work'),
  (49, 'this work is dedicated to the public domain'),
  (50, 'this project is licensed under the mit license'),
  (51, 'this project is licensed under the apache license 2 0'),
  (52, 'this project is licensed under the bsd 3 clause license')
"""
_LICENSE_RULES = [
    ("mit-full", "MIT", ",4,,5,,6,,7,"),
    ("mit-terms", "MIT", ",4,,5,,6,"),
    ("isc-full", "ISC", ",8,,10,"),
    ("0bsd-full", "0BSD", ",9,,10,"),
    ("zlib-full", "Zlib", ",11,,12,,13,"),
    ("apache-header", "Apache-2.0", ",14,,15,,16,,18,,17,"),
    ("apache-header-short", "Apache-2.0", ",14,,15,,16,,17,"),
    ("mpl2-header", "MPL-2.0", ",19,"),
    ("unlicense-full", "Unlicense", ",22,,23,"),
    ("gpl3-header", "GPL-3.0-or-later", ",24,,25,,26,,27,,28,"),
    ("gpl2-header", "GPL-2.0-or-later", ",24,,29,,30,,26,,27,,28,"),
    ("gpl2-only-header", "GPL-2.0-only", ",24,,31,,26,,27,,28,"),
    ("bsd-3-full", "BSD-3-Clause", ",37,,38,,39,,40,,41,"),
    ("bsd-3", "BSD-3-Clause", ",37,,38,,39,,40,"),
    ("bsd-2-full", "BSD-2-Clause", ",37,,38,,39,,41,"),
    ("bsd-2", "BSD-2-Clause", ",37,,38,,39,"),
    ("mit-short", "MIT", ",4,,5,"),
    ("isc-start", "ISC", ",8,"),
    ("apache-start", "Apache-2.0", ",14,,15,"),
    ("unlicense-start", "Unlicense", ",22,"),
    ("gpl3-start", "GPL-3.0-or-later", ",24,,25,"),
    ("gpl2-start", "GPL-2.0-or-later", ",24,,29,,30,"),
    ("gpl2-only-start", "GPL-2.0-only", ",24,,31,"),
    ("lgpl21-start", "LGPL-2.1-or-later", ",32,,33,,34,"),
    ("lgpl3-start", "LGPL-3.0-or-later", ",24,,35,"),
    ("agpl3-start", "AGPL-3.0-or-later", ",24,,36,"),
    ("boost-notice", "BSL-1.0", ",20,"),
    ("epl2-notice", "EPL-2.0", ",21,"),
    ("mit-notice", "MIT", ",0,"),
    ("mit-project", "MIT", ",50,"),
    ("apache-notice", "Apache-2.0", ",1,"),
    ("apache-project", "Apache-2.0", ",51,"),
    ("bsd-3-project", "BSD-3-Clause", ",52,"),
    ("cc-by-nc-notice", "CC-BY-NC-4.0", ",2,"),
    ("gpl3-notice", "GPL-3.0-only", ",3,"),
    ("cc-by-notice", "CC-BY-4.0", ",42,"),
    ("cc-by-sa-notice", "CC-BY-SA-4.0", ",43,"),
    ("cc-by-nc-full", "CC-BY-NC-4.0", ",44,"),
    ("cc-by-nd-notice", "CC-BY-ND-4.0", ",45,"),
    ("cc-by-nc-sa-notice", "CC-BY-NC-SA-4.0", ",46,"),
    ("cc-by-nc-nd-notice", "CC-BY-NC-ND-4.0", ",47,"),
    ("cc0-notice", "CC0-1.0", ",48,"),
    ("public-domain", "Public-Domain", ",49,"),
]


def _license_oracle() -> str:
    steps, left = [], "seq"
    for k, (_, _, pattern) in enumerate(_LICENSE_RULES):
        steps.append(f"contains({left}, '{pattern}') AS r{k}")
        left = f"replace({left}, '{pattern}', '|')"
    names = lambda n: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN r{k} THEN '{x[n]}' END" for k, x in enumerate(_LICENSE_RULES)) + "], lambda x: x IS NOT NULL))), ',')"
    return rf"""
WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[\x0A-\x0D]+') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM s),
k(piece, norm) AS (VALUES {_LICENSE_PIECES}),
h AS (SELECT doc_id, pos, piece FROM u JOIN k ON trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) = norm),
q AS (SELECT doc_id, ',' || string_agg(piece::VARCHAR, ',,' ORDER BY pos) || ',' AS seq, count(*)::INT AS n_sentences, min(pos)::INT AS first_sentence, max(pos)::INT AS last_sentence FROM h GROUP BY doc_id),
r AS (SELECT *, {", ".join(steps)} FROM q)
SELECT * FROM (SELECT doc_id, {names(1)} AS licenses, {names(0)} AS rules, n_sentences, first_sentence, last_sentence FROM r) WHERE licenses <> ''
"""


ORACLES["op9_license_scan"] = _license_oracle()
