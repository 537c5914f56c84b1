"""The catalog's queries in plain SQL, written independently of the operators.

They are the correctness check: nested loops, window by window, no seeds.
"""

from __future__ import annotations

LETTERS = "upper(regexp_replace({}, '[^A-Za-z]', '', 'g'))"

DOCS = f"""docs AS (SELECT doc_id AS rec_idx, CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN source IN ('src0', 'src1') THEN 1 ELSE 2 END AS side, {LETTERS.format('text')} AS seq FROM documents)"""

TURNS = f"""turns AS (SELECT [conv_id, turn] AS rec_idx, CAST(conv_id AS VARCHAR) AS id,
  CASE WHEN role = 'user' THEN 1 ELSE 2 END AS side, {LETTERS.format('text')} AS seq FROM conversations)"""

OWN_TURNS = TURNS.replace("CAST(conv_id AS VARCHAR) AS id", "conv_id || '.' || turn AS id")

ITEMS = f"""items AS (SELECT item_id AS rec_idx, CAST(item_id AS VARCHAR) AS id, {LETTERS.format('text')} AS seq
  FROM benchmark)"""


def _keyed(table: str) -> str:
    return f"""keyed AS (SELECT side, id, arg_max(seq, rec_idx) AS seq, min(rec_idx) AS rec_idx, count(*) AS n_records
  FROM {table} WHERE seq <> '' GROUP BY side, id)"""


def _windows(name: str, source: str, side: str, k: int, ambiguous: bool = False) -> str:
    keep = "" if ambiguous else "WHERE NOT regexp_matches(kmer, '[XBZUO*]')"
    return f"""{name} AS (SELECT DISTINCT {k} AS k, kmer, id, side FROM (SELECT id, {side} AS side,
  unnest(list_transform(range(1, length(seq) - {k} + 2), lambda i: substr(seq, i, {k}))) AS kmer
  FROM {source} WHERE length(seq) >= {k}) {keep})"""


_PILE = """CASE WHEN n1 > 0 AND n2 > 0 THEN 'shared' WHEN n1 > 0 THEN 'only_{0}' ELSE 'only_{1}' END"""


def _counted(source: str, label1: str, label2: str) -> str:
    return f"""counted AS (SELECT *, {_PILE.format(label1, label2)} AS pile FROM (
  SELECT k, kmer, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2,
  coalesce(string_agg(id, ';' ORDER BY id) FILTER (WHERE side = 1), '') AS t1,
  coalesce(string_agg(id, ';' ORDER BY id) FILTER (WHERE side = 2), '') AS t2
  FROM {source} GROUP BY k, kmer))"""


def _plain_counted(source: str, label1: str, label2: str) -> str:
    return f"""counted AS (SELECT *, {_PILE.format(label1, label2)} AS pile FROM (
  SELECT k, kmer, count(*) FILTER (WHERE side = 1) AS n1, count(*) FILTER (WHERE side = 2) AS n2
  FROM {source} GROUP BY k, kmer))"""


_REF = """refs AS (SELECT DISTINCT kmer FROM rwin)"""
_ANNOTATED = """annotated AS (SELECT c.*, r.kmer IS NOT NULL AS ref_match,
  c.pile || '|' || CASE WHEN r.kmer IS NOT NULL THEN 'in_reference' ELSE 'novel' END AS category
  FROM counted c LEFT JOIN refs r USING (kmer))"""


def _reference(table: str, counted: str) -> str:
    source = DOCS if table == "docs" else OWN_TURNS
    return "WITH " + ",\n".join([source, ITEMS, _keyed(table), _windows("win", "keyed", "side", 9),
                                 _windows("rwin", "items", "0", 9), counted, _REF, _ANNOTATED])


# FASTA texts of the documents, their lines, and their records (lists of lines), with positions from 0.
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_FASTA = """texts AS (SELECT doc_id, '>doc' || doc_id || ' ' || coalesce(lang, '') || chr(10) ||
  regexp_replace(coalesce(text, ''), '\\n([A-Da-d])', chr(10) || '>\\1', 'g') AS body FROM documents)"""
LINES = f"""{_FASTA}, cut AS (SELECT doc_id, string_split(body, chr(10)) AS parts FROM texts),
  lines AS (SELECT doc_id, CAST(unnest(range(0, len(parts))) AS INTEGER) AS pos, unnest(parts) AS line FROM cut)"""
RECORDS = f"""{_FASTA}, cut AS (SELECT doc_id, string_split(substr(body, 2), chr(10) || '>') AS parts FROM texts),
  records AS (SELECT doc_id, CAST(unnest(range(0, len(parts))) AS INTEGER) AS pos,
    string_split(regexp_replace(unnest(parts), '\\r\\n?', chr(10), 'g'), chr(10)) AS ls FROM cut)"""
_RECORD_ID = f"regexp_extract(trim(ls[1], {_SPACES}), '^[^ \\t\\n\\r\\f\\v]*')"
_RECORD_BODY = f"array_to_string(list_transform(ls[2:], lambda s: rtrim(s, {_SPACES})), '')"
_UPPER = "upper(replace({}, 'ß', 'ss'))"  # DuckDB has a capital for it
_CLEANED = _UPPER.format(f"rtrim(ltrim(replace({_RECORD_BODY}, ' ', ''), '*'), '*')")

_CATEGORIES = ["shared|in_reference", "shared|novel", "only_short|in_reference", "only_short|novel",
               "only_long|in_reference", "only_long|novel"]
_TABLE = ["only_long_in_reference", "only_long_novel", "only_short_in_reference", "only_short_novel",
          "shared_in_reference", "shared_novel"]

_category_rows = " UNION ALL ".join(
    [f"SELECT {i} AS ord, '{c}' AS category, count(*) FILTER (WHERE category = '{c}') AS n, count(*) AS total FROM annotated"
     for i, c in enumerate(_CATEGORIES)]
    + ["SELECT 6, 'TOTAL', count(*), count(*) FROM annotated",
       "SELECT 7, 'NOVEL', count(*) FILTER (WHERE NOT ref_match), count(*) FROM annotated"])
_table_rows = " UNION ALL ".join(
    f"SELECT '{c}' AS kmer_type, nullif(count(*) FILTER (WHERE replace(category, '|', '_') = '{c}'), 0) AS count FROM annotated"
    for c in _TABLE)
_PCT = "CASE WHEN total > 0 THEN CAST(100 AS DOUBLE) * n / total ELSE 0 END AS pct"


def _pile_summary(ks: list[int], ambiguous: bool) -> str:
    parts = ["docs AS MATERIALIZED" + DOCS[len("docs AS"):], _keyed("docs")]
    parts += [_windows(f"w{k}", "keyed", "side", k, ambiguous) for k in ks]
    parts.append("win AS (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in ks) + ")")
    parts.append(_plain_counted("win", "file1", "file2"))
    parts.append("piles AS (SELECT unnest(['shared', 'only_file1', 'only_file2', 'TOTAL']) AS pile)")
    parts.append("totals AS (SELECT k, count(*) AS total FROM counted GROUP BY k)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT k, pile, n, {_PCT} FROM (SELECT t.k, p.pile, t.total,
  (SELECT count(*) FROM counted c WHERE c.k = t.k AND (c.pile = p.pile OR p.pile = 'TOTAL')) AS n FROM totals t, piles p)"""


WORDS = "unnest(regexp_extract_all({0}, '[A-Za-z]+')) AS w, generate_subscripts(regexp_extract_all({0}, '[A-Za-z]+'), 1) AS p"
DB = f"""db AS (SELECT label, idx, peptide, replace(peptide, 'I', 'L') AS norm FROM (
  SELECT 'docs_' || lang AS label, [doc_id, p - 1] AS idx, upper(w) AS peptide
  FROM (SELECT lang, doc_id, {WORDS.format('text')} FROM documents)))"""
DENOVO = f"""dn AS (SELECT label, idx, peptide, replace(peptide, 'I', 'L') AS norm FROM (
  SELECT 'turns_' || role AS label, [conv_id, turn, p - 1] AS idx,
  translate(upper(w), 'IL', 'LI') AS peptide
  FROM (SELECT role, conv_id, turn, {WORDS.format('text')} FROM conversations)))"""
FIRSTS = """firsts AS (SELECT label AS db_file, norm, min(idx) AS first_idx, arg_min(peptide, idx) AS original
  FROM db GROUP BY label, norm)"""
CONTAINERS = FIRSTS + """,
wanted AS (SELECT DISTINCT norm FROM dn),
held AS (SELECT w.norm, f.db_file, arg_min(f.original, f.first_idx) AS original
  FROM wanted w JOIN firsts f ON contains(f.norm, w.norm) AND f.norm <> w.norm GROUP BY 1, 2),
containers AS (SELECT h.* FROM held h WHERE NOT EXISTS
  (SELECT 1 FROM firsts f WHERE f.db_file = h.db_file AND f.norm = h.norm))"""

UNIQUE = """uniq AS (SELECT seq, min(rec_idx) AS rec_idx, arg_min(id, rec_idx) AS id, count(*) AS n, length(seq) AS len
  FROM docs GROUP BY seq)"""
ABSORBED = """absorbed AS (SELECT p.rec_idx, p.id, p.len, arg_min(t.id, (-t.len, t.rec_idx)) AS absorber
  FROM uniq p JOIN uniq t ON t.len > p.len AND p.len > 0 AND contains(t.seq, p.seq) GROUP BY 1, 2, 3)"""
_DEDUP = "WITH " + ",\n".join([DOCS, UNIQUE, ABSORBED])
_IDENTICAL = """SELECT u.id AS representative_id, d.id AS related_id, 'identical' AS relationship
  FROM docs d JOIN uniq u USING (seq) WHERE d.rec_idx <> u.rec_idx"""
_SUBSTRING = "SELECT absorber AS representative_id, id AS related_id, 'substring' AS relationship FROM absorbed"

PROTEINS = f"""proteins AS (SELECT rec_idx, id, seq, replace(seq, 'I', 'L') AS body FROM docs)"""
PEPTIDES = f"""peptides AS (SELECT item_id AS idx, translate({LETTERS.format('text')}, 'IL', 'LI') AS peptide FROM benchmark)"""
MATCHED = """matched AS (SELECT e.idx, e.peptide, p.id, p.rec_idx, p.seq, p.body
  FROM peptides e JOIN proteins p ON contains(p.body, replace(upper(e.peptide), 'I', 'L')))"""
_MATCH = "WITH " + ",\n".join([DOCS, PROTEINS, PEPTIDES, MATCHED])

MODIFIED = """modified AS (SELECT event_id, CASE WHEN upper(event_type) = 'ERROR' THEN '[only a tag]' ELSE
  ' ' || left(upper(event_type), 1) || '[' || props || ']' || substr(upper(event_type), 2) || '[UNIMOD:' || event_id || ']' END
  AS sequence FROM events)"""
ISOFORMS = f"""isoforms AS (SELECT conv_id, turn, conv_id || '.' || turn AS isoform,
  CASE WHEN length(seq) % 5 = 0 THEN 'NA' ELSE seq || repeat('*', turn % 3) END AS orf
  FROM (SELECT *, {LETTERS.format('text')} AS seq FROM conversations))"""

HITS = """words AS (SELECT DISTINCT upper(role) AS role, upper(w) AS qseq FROM
  (SELECT role, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM conversations)),
varied AS (SELECT *, CASE (length(qseq) + ascii(qseq)) % 4 WHEN 0 THEN qseq WHEN 1 THEN replace(qseq, 'I', 'L')
  WHEN 2 THEN replace(qseq, 'A', 'T') ELSE left(qseq, length(qseq) - 1) END AS sseq FROM words),
aligned AS (SELECT *, length(sseq) AS length,
  CASE WHEN length(sseq) = length(qseq) THEN hamming(qseq, sseq) ELSE 0 END AS mismatch FROM varied WHERE sseq <> ''),
hits AS (SELECT qseq AS query_id, role || '_' || sseq AS subject_id, CAST(100 AS DOUBLE) * (length - mismatch) / length AS pident,
  length, mismatch, qseq, sseq, CAST(0.001 AS DOUBLE) AS evalue FROM aligned)"""
FULL = "length = length(qseq)"
LI = "(mismatch = 0 OR replace(upper(qseq), 'I', 'L') = replace(upper(sseq), 'I', 'L'))"
KEPT = f"kept AS (SELECT * FROM hits WHERE {FULL} AND pident >= 85 AND mismatch <= 1 AND {LI})"

PREDICTIONS = """preds AS (SELECT event_id, upper(event_type) AS key,
  CASE WHEN value > 0.5 THEN value END AS lp, user_id - value AS ppm FROM events),
lookup AS (SELECT upper(event_type) AS key, count(*) FILTER (WHERE user_id % 2 = 0 AND event_type IN ('click', 'purchase')) > 0 AS m
  FROM events WHERE event_type <> 'view' GROUP BY event_type),
annotated AS (SELECT p.*, l.m AS match_status FROM preds p LEFT JOIN lookup l USING (key)),
vals AS (SELECT event_id, CASE WHEN match_status THEN 'MATCH' ELSE 'NO_MATCH' END AS status, metric, value FROM (
  SELECT event_id, match_status, 'instanovoplus_prediction_log_probability' AS metric, lp AS value FROM annotated
  UNION ALL SELECT event_id, match_status, 'delta_mass_ppm', ppm FROM annotated)
  WHERE match_status IS NOT NULL AND value IS NOT NULL)"""

ORACLE: dict[str, str] = {
    "kmer_category_counts_k9": _reference("docs", _plain_counted("win", "short", "long"))
    + f" SELECT ord, category, n, {_PCT} FROM ({_category_rows})",
    "kmer_category_count_table_k9": _reference("turns", _plain_counted("win", "short", "long")) + " " + _table_rows,
    "kmer_pile_summary": _pile_summary([8, 9, 10, 11], False),
    "kmer_pile_summary_keep_ambiguous": _pile_summary([9], True),
    "kmer_piles_k9": "WITH " + ",\n".join([OWN_TURNS, _keyed("turns"), _windows("win", "keyed", "side", 9),
                                          _counted("win", "short", "long")])
    + """ SELECT kmer, pile, t1 AS short_transcripts, t2 AS long_transcripts, n1 AS short_count, n2 AS long_count
    FROM counted""",
    "kmer_postings_k9": "WITH " + ",\n".join([OWN_TURNS, _keyed("turns"), _windows("win", "keyed", "side", 9)])
    + " SELECT kmer, side, id FROM win",
    "kmer_unique_per_source": "WITH " + ",\n".join([OWN_TURNS, _keyed("turns"), _windows("w8", "keyed", "side", 8), _windows("w9", "keyed", "side", 9),
                                                   "win AS (SELECT * FROM w8 UNION ALL SELECT * FROM w9)", _plain_counted("win", "file1", "file2")])
    + """ SELECT k, count(*) FILTER (WHERE n1 > 0) AS file1_unique, count(*) FILTER (WHERE n2 > 0) AS file2_unique,
      count(*) FILTER (WHERE n1 > 0 AND n2 > 0) AS in_both FROM counted GROUP BY k""",
    "kmer_ref_annotate_k9": _reference("turns", _plain_counted("win", "short", "long"))
    + """ SELECT kmer, pile, n1 AS short_count, n2 AS long_count, ref_match, category FROM annotated""",
    "kmer_ref_proteins_k9": _reference("turns", _counted("win", "short", "long"))
    + """, held AS (SELECT kmer, string_agg(id, ';' ORDER BY id) AS ids FROM rwin GROUP BY kmer)
    SELECT kmer, pile, t1 AS short_transcripts, t2 AS long_transcripts, n1 AS short_count, n2 AS long_count,
    ref_match, coalesce(ids, '') AS ref_proteins, category FROM annotated LEFT JOIN held USING (kmer)""",
    "kmer_parse_metrics": f"""WITH {DOCS}, {_keyed('docs')},
    kept AS (SELECT side, id, rec_idx, greatest(length(seq) - 8, 0) AS every,
      list_sum(list_transform(regexp_split_to_array(seq, '[XBZUO*]'), lambda s: greatest(length(s) - 8, 0))) AS clean, seq FROM keyed)
    SELECT count(*) AS n_sequences, count(*) FILTER (WHERE length(seq) < 9) AS skipped_short,
      CAST(sum(every - clean) AS BIGINT) AS skipped_ambiguous FROM kept""",
    "sequence_load_metrics": f"""WITH {TURNS}, {_keyed('turns')}
    SELECT (SELECT count(*) FROM turns) AS n_records, (SELECT count(*) FROM turns WHERE seq = '') AS empty,
      count(*) AS loaded, CAST(sum(n_records) - count(*) AS BIGINT) AS duplicates FROM keyed""",
    "shared_ids": f"""WITH {TURNS} SELECT DISTINCT id FROM turns a WHERE side = 1 AND seq <> '' AND EXISTS
    (SELECT 1 FROM turns b WHERE b.id = a.id AND b.side = 2 AND b.seq <> '')""",
    "li_exact_overlap": f"""WITH {DB}, {DENOVO} SELECT db.label AS db_file, dn.label AS denovo_file,
      db.peptide AS db_original, dn.peptide AS denovo_original, norm AS il_normalized, count(*) AS n_pairs
    FROM db JOIN dn USING (norm) GROUP BY 1, 2, 3, 4, 5""",
    "li_substring_first_match": f"""WITH {DB}, {DENOVO}, {CONTAINERS} SELECT c.db_file, d.label AS denovo_file, d.idx[1] AS conv_id, d.idx[2] AS turn, d.idx[3] AS pos,
      d.peptide AS denovo_original, c.original AS db_containing_peptide FROM dn d JOIN containers c USING (norm)""",
    "overlap_summary": f"""WITH {DB}, {DENOVO}, {CONTAINERS},
    files AS (SELECT db_file, denovo_file FROM (SELECT DISTINCT label AS db_file FROM db), (SELECT DISTINCT label AS denovo_file FROM dn)),
    counts AS (SELECT f.*, (SELECT count(*) FROM db JOIN dn USING (norm) WHERE db.label = f.db_file AND dn.label = f.denovo_file) AS e,
      (SELECT count(*) FROM dn JOIN containers c USING (norm) WHERE c.db_file = f.db_file AND dn.label = f.denovo_file) AS s FROM files f)
    SELECT db_file, denovo_file, e AS exact_overlap, s AS substring_only_overlap, e + s AS total_overlap FROM counts""",
    "venn_counts": f"""WITH {DB}, {DENOVO}, seen AS (SELECT norm, string_agg(DISTINCT label, ' & ' ORDER BY label) AS file_combination
      FROM (SELECT label, norm FROM db UNION ALL SELECT label, norm FROM dn) GROUP BY norm)
    SELECT file_combination, count(*) AS peptide_count FROM seen GROUP BY 1""",
    "shared_norms": f"""WITH {DB} SELECT norm FROM db GROUP BY norm HAVING count(DISTINCT label) = 4""",
    "all_files_overlap": f"""WITH {DB}, shared AS (SELECT norm FROM db GROUP BY norm HAVING count(DISTINCT label) = 4)
    SELECT norm AS normalized_sequence, label, idx[1] AS doc_id, idx[2] AS pos, peptide FROM db WHERE norm IN (SELECT norm FROM shared)""",
    "length_filter_distinct": """SELECT DISTINCT value FROM (SELECT unnest(string_split(text, chr(10))) AS value FROM documents)
    WHERE length(value) > 7""",
    "list_to_fasta": f"""WITH {DB} SELECT row_number() OVER (ORDER BY idx) AS ordinal,
      '>tool_peptide_' || row_number() OVER (ORDER BY idx) || chr(10) || peptide AS record FROM db""",
    "exact_li_match": _MATCH + """, cells AS (SELECT idx, count(*) AS n, string_agg(id, ';' ORDER BY rec_idx) AS ids FROM matched GROUP BY idx)
    SELECT e.idx, e.peptide, coalesce(c.n, 0) AS n_proteins, coalesce(c.ids, 'NO_MATCH') AS protein_ids
    FROM peptides e LEFT JOIN cells c USING (idx)""",
    "matched_fraction": _MATCH + """ SELECT (SELECT count(*) FROM peptides) AS n_peptides, count(DISTINCT idx) AS n_matched,
      CAST(100 AS DOUBLE) * count(DISTINCT idx) / (SELECT count(*) FROM peptides) AS pct FROM matched""",
    "ungapped_li_hits": _MATCH + """, placed AS (SELECT DISTINCT upper(peptide) AS qseq, id, seq, body FROM matched),
    starts AS (SELECT *, unnest(range(1, length(body) - length(qseq) + 2)) AS position FROM placed),
    found AS (SELECT *, substr(seq, position, length(qseq)) AS sseq FROM starts
      WHERE substr(body, position, length(qseq)) = replace(qseq, 'I', 'L'))
    SELECT qseq AS query_id, id AS subject_id, position, length(qseq) AS length, hamming(qseq, sseq) AS mismatch,
      CAST(100 AS DOUBLE) * (length(qseq) - hamming(qseq, sseq)) / length(qseq) AS pident, qseq, sseq FROM found""",
    "dedup_identical": f"WITH {DOCS}, {UNIQUE} {_IDENTICAL}",
    "dedup_substring": f"{_DEDUP} {_SUBSTRING}",
    "dedup_provenance": f"{_DEDUP} {_IDENTICAL} UNION ALL {_SUBSTRING}",
    "dedup_kept": f"{_DEDUP} SELECT rec_idx, id, seq FROM uniq WHERE rec_idx NOT IN (SELECT rec_idx FROM absorbed)",
    "dedup_summary": f"""{_DEDUP} SELECT (SELECT count(*) FROM docs) AS input_entries,
      (SELECT count(*) FROM docs) - (SELECT count(*) FROM uniq) AS identical_collapsed,
      (SELECT count(*) FROM absorbed) AS substrings_removed,
      (SELECT count(*) FROM uniq) - (SELECT count(*) FROM absorbed) AS representatives_kept""",
    "fasta_wrap60": f"""WITH {DOCS} SELECT rec_idx, CASE WHEN seq = '' THEN '>' || id ELSE '>' || id || chr(10) ||
      rtrim(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10)) END AS record FROM docs""",
    "fasta_records": f"""WITH {RECORDS} SELECT doc_id, pos, {_RECORD_ID} AS id, replace({_RECORD_BODY}, ' ', '') AS seq FROM records""",
    "fasta_keyed": f"""WITH {RECORDS}, parsed AS (SELECT doc_id, pos, {_RECORD_ID} AS id, {_CLEANED} AS seq FROM records)
    SELECT id, arg_max(seq, [doc_id, pos]) AS seq, count(*) AS n_records FROM parsed WHERE seq <> '' GROUP BY id""",
    "fasta_ordered": f"""WITH {RECORDS} SELECT doc_id, pos, {_RECORD_ID} AS id, {_UPPER.format(_RECORD_BODY)} AS seq FROM records""",
    "peptide_lines": f"""WITH {LINES} SELECT doc_id, pos, trim(line, {_SPACES}) AS peptide FROM lines WHERE trim(line, {_SPACES}) <> ''""",
    "typed_pile_cells": f"""WITH cells AS (SELECT event_id, upper(event_type) AS kmer, event_id % 6 AS kind, user_id AS n FROM events)
    SELECT event_id, kmer, CASE WHEN kind = 4 THEN '' ELSE 'shared' END AS pile,
      CAST(CASE WHEN kind <= 2 THEN n WHEN kind = 3 THEN 10 * n ELSE 0 END AS BIGINT) AS short_count,
      CAST(CASE WHEN kind = 5 THEN 0 ELSE -n END AS BIGINT) AS long_count FROM cells""",
    "strip_mods": f"""WITH {MODIFIED} SELECT event_id, peptide FROM
      (SELECT event_id, trim(regexp_replace(sequence, '\\[.*?\\]', '', 'g')) AS peptide FROM modified) WHERE peptide <> ''""",
    "token_list_to_sequence": "SELECT event_id, upper(event_type) AS peptide FROM events",
    "prediction_key": f"""WITH {MODIFIED} SELECT event_id, upper(event_type) AS key FROM events
    UNION ALL SELECT -event_id, upper(trim(regexp_replace(sequence, '\\[.*?\\]', '', 'g'))) FROM modified""",
    "qc_to_fasta": f"""WITH {ISOFORMS} SELECT conv_id, turn, '>' || isoform || chr(10) || rtrim(orf, '*') AS record FROM isoforms
    WHERE orf <> '' AND orf <> 'NA'""",
    "qc_counts": f"""WITH {ISOFORMS} SELECT count(*) FILTER (WHERE orf <> '' AND orf <> 'NA') AS written,
      count(*) FILTER (WHERE orf = '' OR orf = 'NA') AS skipped FROM isoforms""",
    "blast_filter": f"""WITH {HITS}, {KEPT} SELECT 'tool' AS tool, query_id, subject_id, pident, mismatch, qseq, sseq, evalue FROM kept""",
    "blast_summary": f"""WITH {HITS}, {KEPT} SELECT 'tool' AS tool, qseq AS peptide, count(DISTINCT subject_id) AS n_proteins
      FROM kept GROUP BY qseq""",
    "blast_subjects": f"""WITH {HITS}, {KEPT} SELECT DISTINCT qseq AS peptide, subject_id AS protein_id FROM kept""",
    "blast_funnel": f"""WITH {HITS} SELECT count(*) AS raw_hits, count(*) FILTER (WHERE {FULL}) AS full_length,
      count(*) FILTER (WHERE {FULL} AND pident >= 90 AND mismatch <= 1) AS after_identity,
      count(*) FILTER (WHERE {FULL} AND pident >= 90 AND mismatch <= 1 AND {LI}) AS after_li FROM hits""",
    "match_lookup": f"WITH {PREDICTIONS} SELECT event_id, key, match_status FROM annotated",
    "annotation_summary": f"""WITH {PREDICTIONS} SELECT count(*) AS n_total, count(match_status) AS n_found,
      count(*) FILTER (WHERE match_status) AS n_match, count(*) FILTER (WHERE NOT match_status) AS n_nomatch,
      count(*) FILTER (WHERE match_status IS NULL) AS n_absent FROM annotated""",
    "box_stats": f"""WITH {PREDICTIONS}, q AS (SELECT metric, status, count(*) AS n, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM vals GROUP BY 1, 2)
    SELECT metric, status, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3,
      round(least(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) AS whisker_low,
      round(greatest(max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) AS whisker_high
    FROM vals JOIN q USING (metric, status) GROUP BY 1, 2""",
    "sampled_points": f"""WITH {PREDICTIONS} SELECT event_id, status, metric, value FROM vals
    QUALIFY row_number() OVER (PARTITION BY metric, status ORDER BY md5('42_' || event_id), event_id) <= 2000""",
}
