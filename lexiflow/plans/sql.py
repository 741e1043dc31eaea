"""Pieces of SQL that several oracle queries share (DuckDB)."""

WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9]"
OTHER = "[^A-Za-zÀ-ÖØ-öø-ÿ0-9\\n]"
PIECES = f"""pieces as (select doc_id, unnest(p) as surface, generate_subscripts(p, 1) as i from (select doc_id, regexp_extract_all(text, '{WORD}+|\\n|{OTHER}+') as p from documents)),
placed as (select *, case when surface = chr(10) then 'break' when regexp_matches(surface, '^{WORD}') then 'word' else 'other' end as kind,
  cast(sum(length(surface)) over w - length(surface) as bigint) as start, cast(sum(length(surface)) over w as bigint) as "end",
  cast(coalesce(sum(length(regexp_replace(surface, '[^.!?\\n]', '', 'g'))) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as sent,
  cast(coalesce(sum(case when surface = chr(10) then 1 else 0 end) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as bigint) as line
  from pieces window w as (partition by doc_id order by i))"""
TOKENS = PIECES + """,
tok as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as pos, surface, lower(surface) as w, start, "end", sent, line from placed where kind = 'word')"""
WORDS = f"""words as (select doc_id, lower(unnest(regexp_extract_all(text, '{WORD}+'))) as w from documents)"""
VOCABULARY = f"""vocab as (select distinct lower(unnest(regexp_extract_all(text, '{WORD}+'))) as w from benchmark)"""
LINES = """lines as (select *, cast(coalesce(sum(length(line) + 1) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from (select doc_id, unnest(l) as line, cast(generate_subscripts(l, 1) as bigint) as line_no from (select doc_id, string_split(text, chr(10)) as l from documents)))"""


def with_(*parts: str, query: str) -> str:
    return "with " + ",\n".join(parts) + "\n" + query
