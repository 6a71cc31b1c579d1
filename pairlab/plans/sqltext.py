"""DuckDB SQL building blocks for the oracle queries: tokenisers and n-gram CTEs."""

from __future__ import annotations


def mteval_norm(x: str, ascii_lower: bool = False) -> str:
    s = f"regexp_replace({x}, '<skipped>', '', 'g')"
    s = f"replace({s}, '-' || chr(10), '')"
    s = f"replace({s}, chr(10), ' ')"
    for old, new in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        s = f"replace({s}, '{old}', '{new}')"
    s = f"(' ' || {s} || ' ')"
    if ascii_lower:
        s = f"translate({s}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    s = f"regexp_replace({s}, '([\\{{-~\\[-` -&\\(-\\+:-@/])', ' \\1 ', 'g')"
    s = f"regexp_replace({s}, '([^0-9])([\\.,])', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '([\\.,])([^0-9])', ' \\1 \\2', 'g')"
    s = f"regexp_replace({s}, '([0-9])(-)', '\\1 \\2 ', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return f"trim({s})"


def mteval_tokens(x: str, how: str = "mteval") -> str:
    if how == "mteval":
        return f"list_transform(string_split({mteval_norm(x)}, ' '), lambda w: lower(w))"
    if how == "perl":
        return f"list_filter(string_split({mteval_norm(x, ascii_lower=True)}, ' '), lambda w: w <> '')"
    raise ValueError(how)


CAPTION_PUNCT_SQL = ("['''''', '''', '``', '`', '-LRB-', '-RRB-', '-LCB-', '-RCB-', "
                     "'.', '?', '!', ',', ':', '-', '--', '...', ';']")


def caption_text(x: str) -> str:
    toks = (f"regexp_extract_all(lower(replace({x}, chr(10), ' ')), "
            f"'[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')")
    return f"array_to_string(list_filter({toks}, lambda w: NOT list_contains({CAPTION_PUNCT_SQL}, w)), ' ')"


def caption_tokens(x: str) -> str:
    """whitespace split (no empty tokens)"""
    return f"list_filter(string_split({caption_text(x)}, ' '), lambda w: w <> '')"


def tok_ctes(how: str = "mteval", refs: str = "seg_refs", sys: str = "seg_sys") -> str:
    if how in ("mteval", "perl"):
        rt = mteval_tokens("ref", how)
        stt = mteval_tokens("sys", how)
    elif how == "caption":
        rt, stt = caption_tokens("ref"), caption_tokens("sys")
    elif how == "blank":
        rt, stt = f"string_split({caption_text('ref')}, ' ')", f"string_split({caption_text('sys')}, ' ')"
    else:
        raise ValueError(how)
    return (f"rt AS (SELECT inst_id, ref_no, {rt} AS toks FROM {refs}),\n"
            f"st AS (SELECT inst_id, {stt} AS toks FROM {sys})")


def gram_ctes(max_n: int) -> str:
    """rc (inst_id, ref_no, n, gram, cnt), rmax (inst_id, n, gram, rmax), sc (inst_id, n, gram, cnt),
    hits (inst_id, n, hits) for every order incl. zero, lens (inst_id, slen, rlen_closest, nrefs, rsum)."""
    return f"""
rg AS (SELECT inst_id, ref_no, n, array_to_string(toks[i:i + n - 1], ' ') AS gram
       FROM (SELECT inst_id, ref_no, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
             FROM rt, range(1, {max_n + 1}) o(n))),
rc AS (SELECT inst_id, ref_no, n, gram, count(*) AS cnt FROM rg GROUP BY inst_id, ref_no, n, gram),
rmax AS (SELECT inst_id, n, gram, max(cnt) AS rmax FROM rc GROUP BY inst_id, n, gram),
sg AS (SELECT inst_id, n, array_to_string(toks[i:i + n - 1], ' ') AS gram
       FROM (SELECT inst_id, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
             FROM st, range(1, {max_n + 1}) o(n))),
sc AS (SELECT inst_id, n, gram, count(*) AS cnt FROM sg GROUP BY inst_id, n, gram),
hitg AS (SELECT sc.inst_id, sc.n, sc.gram, least(sc.cnt, coalesce(rmax.rmax, 0)) AS hits
         FROM sc LEFT JOIN rmax USING (inst_id, n, gram)),
hits0 AS (SELECT inst_id, n, sum(hits) AS hits FROM hitg GROUP BY inst_id, n),
hits AS (SELECT st.inst_id, o.n, coalesce(h.hits, 0) AS hits
         FROM st CROSS JOIN range(1, {max_n + 1}) o(n) LEFT JOIN hits0 h ON h.inst_id = st.inst_id AND h.n = o.n),
lens AS (SELECT s.inst_id, len(s.toks) AS slen,
                arg_min(len(r.toks), abs(len(r.toks) - len(s.toks)) * 100000000 + len(r.toks)) AS rlen_closest,
                arg_min(len(r.toks), CASE WHEN len(r.toks) > 0 THEN abs(len(r.toks) - len(s.toks)) * 100000000 + len(r.toks) END) AS rlen_closest_nz,
                sum(CASE WHEN len(r.toks) > 0 THEN 1 ELSE 0 END) AS nrefs_nz,
                min(len(r.toks)) AS rlen_short, avg(len(r.toks)) AS rlen_avg,
                count(*) AS nrefs, sum(len(r.toks)) AS rsum
         FROM st s JOIN rt r USING (inst_id) GROUP BY s.inst_id, len(s.toks))"""
