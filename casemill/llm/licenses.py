"""Licence scans by sentence rules, with DataFrame operations only.

A text with a licence cue is cut into sentences, each is normalised (lower case, runs of other than letters and digits become a
space) and mapped to the identifier of a known licence sentence, or to `unknown` where it speaks of licences in no known way.
The identifiers in order are then matched against ordered licence rules, the most specific first; what a rule matches is
consumed, so a shorter rule cannot claim it again.  An SPDX tag gives an identifier for each licence of its expression.  All of it is
expressions on one row: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cues, the wording of public licences, and the order of the rules.
# The cue only saves work, so whatever a sentence pattern matches has to pass it, by whatever its words are parted.
CUE = (
    r"(?i)licen[cs]e|copyright|all[^a-z0-9]+rights[^a-z0-9]+reserved|spdx|permission|redistribut|warrant|free[^a-z0-9]+software|unencumbered|proprietary"
    r"|public[^a-z0-9]+domain|creative[^a-z0-9]+commons|cc0|cc[^a-z0-9]+by|endorse|under[^a-z0-9]+(?:the[^a-z0-9]+)?mit\b|apache|\bbsd|\b[al]?gpl|\b[me]pl|\bofl|\bisc\b|zlib"
)
_GIVEN = r"(licensed|released|available|distributed|provided|published|covered) under (the )?"
SENTENCES = (
    ("denied", r"\b(not|never|no longer|neither) (being |be )?(licensed|released|available|distributed|provided|published|covered) under\b"),
    ("version_3_plus", r"^(either )?version 3 of the (gnu )?(lesser |affero )?(general public )?licen[cs]e or (at your option )?any later version"),
    ("version_2_1_plus", r"^(either )?version 2 1 of the (gnu )?(lesser )?(general public )?licen[cs]e or (at your option )?any later version"),
    ("version_2_plus", r"^(either )?version 2 of the (gnu )?(general public )?licen[cs]e or (at your option )?any later version"),
    ("cc_by_nc_sa_4", r"\bcc by nc sa 4 0|creative commons attribution non ?commercial share ?alike 4 0"),
    ("cc_by_nc_nd_4", r"\bcc by nc nd 4 0|creative commons attribution non ?commercial no ?deriv\w* 4 0"),
    ("cc_by_nc_4", r"\bcc by nc 4 0|creative commons attribution non ?commercial 4 0"),
    ("cc_by_sa_4", r"\bcc by sa 4 0|creative commons attribution share ?alike 4 0"),
    ("cc_by_nd_4", r"\bcc by nd 4 0|creative commons attribution no ?deriv\w* 4 0"),
    ("cc_by_4", r"\bcc by 4 0|creative commons attribution 4 0"),
    ("cc_by_sa_3", r"\bcc by sa 3 0|creative commons attribution share ?alike 3 0"),
    ("cc_by_3", r"\bcc by 3 0|creative commons attribution 3 0"),
    ("unlicense", r"free and unencumbered software released into the public domain|\bthe unlicen[cs]e\b"),
    ("cc_0", r"\bcc0\b|dedicated to the public domain|public domain dedication"),
    ("apache_2_comply", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache_2_copy", r"you may obtain a copy of the licen[cs]e at"),
    ("apache_2_warranty", r"software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache_2_ref", r"\bapache (software )?licen[cs]e (version |v ?)?2( 0)?\b|\bapache (v ?)?2 0\b"),
    ("agpl_3", r"gnu affero general public licen[cs]e|\bagpl"),
    ("lgpl_3", r"(gnu (lesser|library) general public licen[cs]e|\blgpl) ?(version |v ?)?3"),
    ("lgpl_2_1", r"(gnu (lesser|library) general public licen[cs]e|\blgpl) ?(version |v ?)?2 1"),
    ("lgpl_2", r"(gnu (lesser|library) general public licen[cs]e|\blgpl) ?(version |v ?)?2\b"),
    ("lgpl_ref", r"gnu (lesser|library) general public licen[cs]e|\blgpl"),
    ("gpl_3_plus", r"(gnu general public licen[cs]e|\bgpl)\b.*\bv?(ersion )?3( 0)?( of the licen[cs]e)? or (at your option )?(any )?(later|newer)|\bgpl ?v?3( 0)? or later"),
    ("gpl_2_plus", r"(gnu general public licen[cs]e|\bgpl)\b.*\bv?(ersion )?2( 0)?( of the licen[cs]e)? or (at your option )?(any )?(later|newer)|\bgpl ?v?2( 0)? or later"),
    ("gpl_3_ref", r"(gnu general public licen[cs]e|\bgpl) ?(version |v ?)?3"),
    ("gpl_2_ref", r"(gnu general public licen[cs]e|\bgpl) ?(version |v ?)?2"),
    ("gpl_ref", r"gnu general public licen[cs]e|\bgpl\b"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("mit_warranty", r"the software is provided as is without warranty of any kind"),
    ("mit_ref", rf"\bmit licen[cs]e\b|{_GIVEN}mit\b"),
    ("isc_grant", r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_ref", r"\bisc licen[cs]e"),
    ("zlib_warranty", r"this software is provided as is without any express or implied warranty"),
    ("zlib_grant", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("zlib_ref", r"\bzlib licen[cs]e"),
    ("bsd_grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse or promote products"),
    ("bsd_3_ref", r"\bbsd 3 clause|\b3 clause bsd|\b(new|modified|revised) bsd licen[cs]e"),
    ("bsd_2_ref", r"\bbsd 2 clause|\b2 clause bsd|\bsimplified bsd licen[cs]e"),
    ("bsd_ref", rf"\bbsd (style )?licen[cs]e|{_GIVEN}bsd\b"),
    ("mpl_2", r"mozilla public licen[cs]e (version |v ?)?2( 0)?|\bmpl ?(version |v ?)?2 0"),
    ("epl_2", r"eclipse public licen[cs]e (version |v ?)?2( 0)?|\bepl ?(version |v ?)?2 0"),
    ("epl_1", r"eclipse public licen[cs]e (version |v ?)?1( 0)?|\bepl ?(version |v ?)?1 0"),
    ("boost_1", r"boost software licen[cs]e"),
    ("artistic_2", r"artistic licen[cs]e (version |v ?)?2( 0)?"),
    ("ofl_1_1", r"sil open font licen[cs]e|\bofl 1 1"),
    ("psf_2", r"python software foundation licen[cs]e"),
    ("spdx_tag", r"spdx licen[cs]e identifier"),
    ("all_rights", r"^all rights reserved$|copyright .*all rights reserved|\bproprietary and confidential\b"),
    ("copyright", r"\bcopyright\b"),
    ("unknown", r"licen[cs]e|permission|redistribut|free software|warrant"),
)
# Each rule's sentences in order; those with a question mark may be missing.  Sentences of no known meaning may stand between.
RULES = (
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("MIT", ("mit_ref?", "mit_grant", "mit_notice", "mit_warranty?")),
    ("Apache-2.0", ("apache_2_ref", "apache_2_comply?", "apache_2_copy?", "apache_2_warranty?")),
    ("Zlib", ("zlib_ref?", "zlib_warranty", "zlib_grant")),
    ("ISC", ("isc_ref?", "isc_grant")),
    ("AGPL-3.0", ("agpl_3", "version_3_plus?")),
    ("LGPL-3.0", ("lgpl_ref", "version_3_plus")),
    ("LGPL-2.1", ("lgpl_ref", "version_2_1_plus")),
    ("LGPL-2.0", ("lgpl_ref", "version_2_plus")),
    ("GPL-3.0-or-later", ("gpl_ref", "version_3_plus")),
    ("GPL-2.0-or-later", ("gpl_ref", "version_2_plus")),
    ("LGPL-3.0", ("lgpl_3",)),
    ("LGPL-2.1", ("lgpl_2_1",)),
    ("LGPL-2.0", ("lgpl_2",)),
    ("LGPL", ("lgpl_ref",)),
    ("GPL-3.0-or-later", ("gpl_3_plus",)),
    ("GPL-2.0-or-later", ("gpl_2_plus",)),
    ("GPL-3.0", ("gpl_3_ref",)),
    ("GPL-2.0", ("gpl_2_ref",)),
    ("GPL", ("gpl_ref",)),
    ("BSD-3-Clause-ref", ("bsd_3_ref",)),
    ("BSD-2-Clause-ref", ("bsd_2_ref",)),
    ("BSD-ref", ("bsd_ref",)),
    ("MIT-ref", ("mit_ref",)),
    ("ISC-ref", ("isc_ref",)),
    ("Zlib-ref", ("zlib_ref",)),
    ("MPL-2.0", ("mpl_2",)),
    ("EPL-2.0", ("epl_2",)),
    ("EPL-1.0", ("epl_1",)),
    ("BSL-1.0", ("boost_1",)),
    ("Artistic-2.0", ("artistic_2",)),
    ("OFL-1.1", ("ofl_1_1",)),
    ("PSF-2.0", ("psf_2",)),
    ("Unlicense", ("unlicense",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa_4",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd_4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa_4",)),
    ("CC-BY-ND-4.0", ("cc_by_nd_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("CC-BY-SA-3.0", ("cc_by_sa_3",)),
    ("CC-BY-3.0", ("cc_by_3",)),
    ("CC0-1.0", ("cc_0",)),
    ("Proprietary", ("all_rights",)),
)
# Where a sentence goes on with another licence by name, that part is a sentence of its own.
NAMED = "mit|apache|gnu|[al]?gpl|mozilla|mpl|eclipse|epl|bsd|isc|zlib|cc0|cc[ -]by|creative commons"
NEXT = rf"(?i)[\s,]+(?:and/or|or|and)\s+((?:under\s+)?(?:the\s+)?(?:{NAMED})\b)"
PROPRIETARY = "Proprietary"
#: Sentences of no known meaning that may stand between two of a licence.
GAP = 3
# What an SPDX tag's expression may name: the identifier, the licence among the rules, the names in lower case.
SPDX_TAG = r"spdx[^a-z0-9]+licen[cs]e[^a-z0-9]+identifier[^a-z0-9]+([a-z0-9.+-]+(?:[ \t)]+(?:or|and|with)[ \t(]+[a-z0-9.+-]+)*)"
SPDX = (
    ("spdx_bsd_3", "BSD-3-Clause", r"bsd-3-clause"),
    ("spdx_bsd_2", "BSD-2-Clause", r"bsd-2-clause"),
    ("spdx_mit", "MIT", r"mit"),
    ("spdx_apache_2", "Apache-2.0", r"apache-2\.0"),
    ("spdx_zlib", "Zlib", r"zlib"),
    ("spdx_isc", "ISC", r"isc"),
    ("spdx_agpl_3", "AGPL-3.0", r"agpl-3\.0(-only|-or-later|\+)?"),
    ("spdx_lgpl_3", "LGPL-3.0", r"lgpl-3\.0(-only|-or-later|\+)?"),
    ("spdx_lgpl_2_1", "LGPL-2.1", r"lgpl-2\.1(-only|-or-later|\+)?"),
    ("spdx_lgpl_2", "LGPL-2.0", r"lgpl-2\.0(-only|-or-later|\+)?"),
    ("spdx_gpl_3_plus", "GPL-3.0-or-later", r"gpl-3\.0(-or-later|\+)"),
    ("spdx_gpl_2_plus", "GPL-2.0-or-later", r"gpl-2\.0(-or-later|\+)"),
    ("spdx_gpl_3", "GPL-3.0", r"gpl-3\.0(-only)?"),
    ("spdx_gpl_2", "GPL-2.0", r"gpl-2\.0(-only)?"),
    ("spdx_gpl", "GPL", r"gpl-1\.0(-only|-or-later|\+)?"),
    ("spdx_mpl_2", "MPL-2.0", r"mpl-2\.0(-no-copyleft-exception)?"),
    ("spdx_epl_2", "EPL-2.0", r"epl-2\.0"),
    ("spdx_epl_1", "EPL-1.0", r"epl-1\.0"),
    ("spdx_bsl_1", "BSL-1.0", r"bsl-1\.0"),
    ("spdx_artistic_2", "Artistic-2.0", r"artistic-2\.0"),
    ("spdx_ofl_1_1", "OFL-1.1", r"ofl-1\.1(-rfn|-no-rfn)?"),
    ("spdx_psf_2", "PSF-2.0", r"(psf|python)-2\.0"),
    ("spdx_unlicense", "Unlicense", r"unlicense"),
    ("spdx_cc_by_nc_sa_4", "CC-BY-NC-SA-4.0", r"cc-by-nc-sa-4\.0"),
    ("spdx_cc_by_nc_nd_4", "CC-BY-NC-ND-4.0", r"cc-by-nc-nd-4\.0"),
    ("spdx_cc_by_nc_4", "CC-BY-NC-4.0", r"cc-by-nc-4\.0"),
    ("spdx_cc_by_sa_4", "CC-BY-SA-4.0", r"cc-by-sa-4\.0"),
    ("spdx_cc_by_nd_4", "CC-BY-ND-4.0", r"cc-by-nd-4\.0"),
    ("spdx_cc_by_4", "CC-BY-4.0", r"cc-by-4\.0"),
    ("spdx_cc_by_sa_3", "CC-BY-SA-3.0", r"cc-by-sa-3\.0"),
    ("spdx_cc_by_3", "CC-BY-3.0", r"cc-by-3\.0"),
    ("spdx_cc_0", "CC0-1.0", r"cc0-1\.0"),
)


def rule_pattern(parts: tuple[str, ...]) -> str:
    """A rule over identifiers that each stand between commas of their own; up to GAP unknown sentences may part them."""
    gap, out, begun = f"(?:,unknown,){{0,{GAP}}}", "", False
    for part in parts:
        name = f",{part.removesuffix('?')},"
        if part.endswith("?"):
            out += f"(?:{gap}{name})?" if begun else f"(?:{name}{gap})?"
        else:
            out += (gap if begun else "") + name
            begun = True
    return out


def sentence_id(sentence: Column) -> Column:
    """The identifier of a sentence as it stands, or null where it has no licence wording."""
    norm = F.trim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(norm.rlike(pattern), name).otherwise(out)
    return out


def spdx_ids(sentence: Column) -> Column:
    """The identifiers of the licences that a sentence's SPDX tags name, `spdx_tag` for one that is not among the rules."""
    tags = F.regexp_extract_all(F.lower(sentence), F.lit(SPDX_TAG), F.lit(1))

    def of(name: Column) -> Column:
        out = F.lit("spdx_tag")
        for ident, _, pattern in reversed(SPDX):
            out = F.when(name.rlike(f"^{pattern}$"), ident).otherwise(out)
        return out

    # exceptions are no licences, and a full stop may follow a name
    names = F.flatten(F.transform(tags, lambda t: F.regexp_extract_all(F.regexp_replace(t, r"[ \t)](or|and|with[ \t(]+\S+)(?=[ \t(]|$)", " "), F.lit(r"[a-z0-9][a-z0-9.+-]*"), F.lit(0))))
    return F.transform(names, lambda n: of(F.regexp_replace(n, r"[.-]+$", "")))


def sentence_ids(sentence: Column) -> Column:
    """The identifiers of a sentence: its own, if any, then those of its SPDX tags."""
    own = F.array_compact(F.array(sentence_id(sentence)))
    tagged = spdx_ids(sentence)
    return F.when(sentence.rlike("(?i)spdx") & (F.size(tagged) > 0), F.concat(F.filter(own, lambda x: x != "spdx_tag"), tagged)).otherwise(own)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids (in order, by commas), n_sentences (recognised; of SPDX tags, each licence they name), n_unknown, licenses (in the rules' order, by +, or NONE).

    A text without licence wording, empty or null has no identifiers and licence NONE, and so has one that only denies a licence;
    one whose wording no rule matches has UNKNOWN.  Proprietary stands only where no other licence does.  A very long text is one row.  Repeated rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    text = F.col("text").cast("string")
    cued = F.filter(F.split(F.regexp_replace(text, r"([.!?;])\s+|\n\s*\n", "$1\u0001"), "\u0001"), lambda s: s.rlike(CUE))
    # an SPDX expression joins names in its own way
    parts = F.transform(cued, lambda s: F.when(s.rlike("(?i)spdx"), F.array(s)).otherwise(F.split(F.regexp_replace(s, NEXT, "\u0001$1"), "\u0001")))
    cued = F.flatten(parts)
    ids = F.when(text.rlike(CUE), F.flatten(F.transform(cued, sentence_ids))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), ids.alias("ids"))
    rows = rows.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"))
    names = F.array(*[F.lit(name) for name in dict.fromkeys(name for name, _ in RULES)])
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(rule_pattern(parts)).alias("pattern")) for name, parts in RULES])
    of_tag = F.create_map(*[F.lit(x) for ident, name, _ in SPDX for x in (ident, name)])
    # copyright lines may stand between the sentences of one licence
    own = F.filter(F.split("sentence_ids", ","), lambda x: x != "copyright")
    left = F.concat(F.lit(","), F.array_join(own, ",,"), F.lit(","))

    def apply(state: Column, rule: Column) -> Column:
        """What a rule matches is replaced by a mark, so that it is not claimed again and its neighbours do not meet."""
        rest = F.regexp_replace(state["rest"], rule["pattern"], F.lit(",#,"))
        return F.struct(rest.alias("rest"), F.when(rest != state["rest"], F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"))

    start = F.struct(left.alias("rest"), F.array().cast("array<string>").alias("found"))
    tagged = F.transform(F.split("sentence_ids", ","), lambda x: F.try_element_at(of_tag, x))
    hit = F.concat(F.aggregate(rules, start, apply)["found"], F.array_compact(tagged))
    # all rights are reserved beside many a licence; that is one only where there is no other
    listed = F.get(F.transform(F.array(hit), lambda h: F.filter(names, lambda n: F.array_contains(h, n) & ((n != PROPRIETARY) | F.forall(h, lambda x: x == PROPRIETARY)))), 0)
    known = F.array_join(listed, "+")
    n_unknown = F.size(F.filter(F.split("sentence_ids", ","), lambda x: x == "unknown")).cast("long")
    denied = F.forall(F.split("sentence_ids", ","), lambda x: x == "denied")
    licenses = F.when((F.col("n_sentences") == 0) | denied, "NONE").otherwise(F.coalesce(F.nullif(known, F.lit("")), F.lit("UNKNOWN")))
    return rows.select("doc_id", "sentence_ids", "n_sentences", n_unknown.alias("n_unknown"), licenses.alias("licenses"))


def license_sql() -> str:
    """The same in DuckDB SQL, from the same sentences and rules, but without the licences of SPDX tags."""
    case = " ".join(f"WHEN regexp_matches(norm, '{p}') THEN '{n}'" for n, p in SENTENCES)
    steps, names = ["l0 AS (SELECT *, ',' || array_to_string(list_filter(ids, lambda x: x <> 'copyright'), ',,') || ',' AS rest0 FROM i)"], {}
    for k, (name, parts) in enumerate(RULES):
        pattern = rule_pattern(parts)
        steps.append(f"l{k + 1} AS (SELECT *, CASE WHEN regexp_matches(rest{k}, '{pattern}') THEN '{name}' END AS f{k}, regexp_replace(rest{k}, '{pattern}', ',#,', 'g') AS rest{k + 1} FROM l{k})")
        names.setdefault(name, []).append(f"f{k}")
    reserved = names.pop(PROPRIETARY)[0]
    found = ", ".join(f"coalesce({', '.join(f)}, NULL)" for f in names.values())
    return f"""
WITH s AS (
  SELECT doc_id, row_number() OVER () AS r, flatten(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?;])\\s+|\\n\\s*\\n', '\\1' || chr(1), 'g'), chr(1)),
    lambda p: CASE WHEN regexp_matches(p, '(?i)spdx') THEN [p] ELSE string_split(regexp_replace(p, '{NEXT}', chr(1) || '\\1', 'g'), chr(1)) END)) AS parts FROM documents
), u AS (SELECT r, generate_subscripts(parts, 1) AS pos, unnest(parts) AS sentence FROM s),
n AS (SELECT r, pos, trim(regexp_replace(lower(sentence), '[^a-z0-9]+', ' ', 'g')) AS norm FROM u WHERE regexp_matches(sentence, '{CUE}')),
c AS (SELECT r, pos, CASE {case} END AS id FROM n),
g AS (SELECT r, list(id ORDER BY pos) AS ids FROM c WHERE id IS NOT NULL GROUP BY r),
i AS (SELECT s.doc_id, coalesce(g.ids, []) AS ids FROM s LEFT JOIN g USING (r)),
{", ".join(steps)}
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, len(ids)::BIGINT AS n_sentences, len(list_filter(ids, lambda x: x = 'unknown'))::BIGINT AS n_unknown,
  CASE WHEN coalesce({found}) IS NOT NULL THEN concat_ws('+', {found}) WHEN {reserved} IS NOT NULL THEN {reserved} WHEN len(list_filter(ids, lambda x: x <> 'denied')) > 0 THEN 'UNKNOWN' ELSE 'NONE' END AS licenses
FROM l{len(RULES)}
"""
