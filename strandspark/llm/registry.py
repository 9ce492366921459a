"""The queries of this subpackage and the SQL that those which SQL can express must agree with."""

from __future__ import annotations

from . import alignment, bpe, decontaminate, fingerprints, html_text, line_dedup, merkle, near_dedup, secrets, shards, token_counts, token_files, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.query,
    "op2_shards": shards.query,
    "op3_token_counts": token_counts.query,
    "op4_html_text": html_text.query,
    "op5_token_files": token_files.query,
    "op6_toxicity": toxicity.query,
    "op7_bpe": bpe.query,
    "op8_fingerprints": fingerprints.query,
    "op9_decontaminate": decontaminate.query,
    "op10_secrets": secrets.query,
    "op11_alignment": alignment.query,
    "op12_merkle": merkle.query,
    "op13_line_dedup": line_dedup.query,
}

def _merkle_sql(levels: int = 7) -> str:
    """Levels written out one by one, enough for 8**levels rows of a language; crc32 by its table."""
    each = " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(cast(doc_id as varchar), ''), lambda s: ascii(s))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    tab = "select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab"

    def tree(t: str) -> list[str]:
        """t0 (grp, i, h) is given: the levels above it, and of each node what stands before and after it in its run."""
        run = "over (partition by grp, i // 8 order by i rows between"
        out = []
        for k in range(levels + 1):
            if k:
                out.append(f"{t}{k} as (select grp, i // 8 as i, sha256(string_agg(h, '' order by i)) as h from {t}s{k - 1} where m > 1 group by grp, i // 8)")
            out.append(f"{t}s{k} as (select grp, i, h, count(*) over (partition by grp) as m, coalesce(string_agg(h, '') {run} unbounded preceding and 1 preceding), '') as a, coalesce(string_agg(h, '') {run} 1 following and unbounded following), '') as b from {t}{k})")
        return out

    def climb(p: str, t: str) -> list[str]:
        """p0 (doc_id, leaf, grp, i, g, proof, ...): folded and proved level by level."""
        return [f"{p}{k + 1} as (select p.* exclude (i, g, proof), p.i // 8 as i, case when s.m > 1 then sha256(a || g || b) else g end as g, case when s.m > 1 then proof || a || b else proof end as proof from {p}{k} p left join {t}s{k} s on s.grp = p.grp and s.i = p.i)" for k in range(levels + 1)]

    parts = [
        f"c as ({tab})",
        f"d as (select doc_id, coalesce('.' || lang, '') as grp, sha256({each.format(text='text')}) as leaf, case when {crc} % 3 = 0 then sha256({each.format(text=lower)}) end as other from documents, c)",
        "n0 as (select grp, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i, leaf as h, doc_id, other from d)",
        *tree("n"),
        "r as (" + " union all ".join(f"select grp, h from ns{k} where m = 1" for k in range(levels + 1)) + ")",
        "t0 as (select '' as grp, row_number() over (order by grp) - 1 as i, h, grp as lang from r)",
        *tree("t"),
        "p0 as (select doc_id, h as leaf, grp, i, coalesce(other, h) as g, '' as proof from n0)",
        *climb("p", "n"),
        f"q0 as (select p.doc_id, p.leaf, t0.h as subroot, '' as grp, t0.i, p.g, p.proof from p{levels + 1} p join t0 on t0.lang = p.grp)",
        *climb("q", "t"),
        "top as (" + " union all ".join(f"select h from ts{k} where m = 1" for k in range(levels + 1)) + ")",
    ]
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, g as folded_root, g = h as verified from q{levels + 1}, top"


ORACLES: dict[str, str] = {
    "op1_near_dedup": """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
 s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) end as sh from w),
 n as (select doc_id, cast(len(sh) as bigint) as n from s),
 u as (select doc_id, unnest(sh) as g from s),
 c as (select x.doc_id as a, y.doc_id as b, count(*) as c from u x join u y on x.g = y.g and x.doc_id < y.doc_id group by 1, 2),
 e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
 linked as (select a, b from e union select b, a from e),
 reached(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reached r join linked l on r.b = l.a)
 select n.doc_id, n.n as n_shingles, min(b) as component_id, min(b) = n.doc_id as kept from n join reached on a = n.doc_id group by n.doc_id, n.n""",
    "op13_line_dedup": """with l as (select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
 f as (select key, min(doc_id) as first from l where length(key) >= 10 group by key having min(doc_id) <> max(doc_id)),
 m as (select l.doc_id, l.pos, l.line, f.key is not null and f.first <> l.doc_id as gone from l left join f on f.key = l.key)
 select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256 from m group by doc_id""",
    "op12_merkle": _merkle_sql(),
}
