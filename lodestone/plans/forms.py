"""Registered queries: forms of notes, names, labels and replies; SQL of the splitter's packing and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import render as R
from ..functions import split as S
from ..functions import text as T
from ..operators import classify, context, segment
from ..operators.fulltext import TextIndex
from ..sources import files, sinks
from ..sources.shared import new_folder
from .notes import _tok, query  # registers with the notes
from .tables import item_queries, table, texts


@query(r"""with c as (select conv_id, turn, case turn % 3 when 0 then '---' || chr(10) || 'role: ' || role || chr(10) || '---' || chr(10) || text || chr(10) when 1 then '---' || text else text end as content from conversations),
    s as (select *, instr(substring(content, 4), '---') as behind from c)
    select conv_id, turn, case when starts_with(content, '---') and behind > 0 then substring(content, 4, behind - 1) end as yaml,
      case when starts_with(content, '---') and behind > 0 then regexp_replace(substring(content, behind + 6), '^\s+|\s+$', '', 'g') else content end as body from s""")
def frontmatter(spark, d):
    """Notes with front matter, with its start only, and without."""
    c = table(spark, d, "conversations")
    whole = F.concat(F.lit("---\nrole: "), "role", F.lit("\n---\n"), "text", F.lit("\n"))
    p = T.frontmatter(F.when(F.col("turn") % 3 == 0, whole).when(F.col("turn") % 3 == 1, F.concat(F.lit("---"), "text")).otherwise(F.col("text")))
    return c.select("conv_id", "turn", p["yaml"].alias("yaml"), p["body"].alias("body"))


@query("""with n as (select page_id, case when page_id % 4 < 2 then '---' || chr(10) else '' end || url || case when page_id % 2 = 0 then ' arxiv_id' else '' end || repeat(' ', 1000) || 'type: paper' as note from pages where url is not null)
    select page_id, starts_with(note, '---') and (contains(substring(note, 1, 1024), 'arxiv.org') or contains(substring(note, 1, 1024), 'arxiv_id') or contains(substring(note, 1, 1024), 'type: paper')) as paper from n""")
def paper_notes(spark, d):
    p = table(spark, d, "pages").where("url is not null")
    head = F.when(F.col("page_id") % 4 < 2, "---\n").otherwise("")
    note = F.concat(head, "url", F.when(F.col("page_id") % 2 == 0, " arxiv_id").otherwise(""), F.lit(" " * 1000 + "type: paper"))
    return p.select("page_id", T.is_paper(note).alias("paper"))


@query(r"""select page_id, regexp_matches(string_split(url, '/')[-1], '^[._]') or contains(url, '/.obsidian/') or contains(url, '/de/') as skipped,
    list_contains(string_split(url, '/'), 'en') or list_contains(string_split(url, '/'), 'fr') as foreign_part from pages where url is not null""")
def skipped_paths(spark, d):
    """Addresses as paths: those below a skipped folder, and those with a part of a list."""
    p = table(spark, d, "pages").where("url is not null")
    return p.select("page_id", classify.skipped_path(F.col("url"), ["/de/"]).alias("skipped"), classify.has_part(F.col("url"), ["en", "fr"]).alias("foreign_part"))


@query("""select p_partkey, '[' || p_partkey || '] ' || replace(p_name, '/', '') || '.md' || case when p_size % 2 = 1 then ' p.' || p_size else '' end || case p_size % 3 when 0 then ' figure' when 1 then ' table' else '' end
    || chr(10) || p_type as part from part""")
def citations(spark, d):
    """Passages with their labels: pages and kinds of chunk where there are any."""
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 3 == 0, "figure").when(F.col("p_size") % 3 == 1, "table").otherwise("text")
    label = context.citation(F.concat(F.lit("/notes/"), F.replace("p_name", F.lit("/"), F.lit("")), F.lit(".md")), kind, F.when(F.col("p_size") % 2 == 1, F.col("p_size")).otherwise(0))
    return p.select("p_partkey", context.part(F.col("p_partkey"), label, F.col("p_type")).alias("part"))


@query("""select p_partkey, p_type || '|' || p_size || '）' as marks, p_partkey % 50 as page, 'img_p' || lpad((p_partkey % 50)::varchar, 3, '0') || '_' || lpad((p_size % 1000)::varchar, 3, '0') || '.png' as name,
    '- ' || p_name || chr(10) || '- ' || p_brand as points, '[title]' || chr(10) || p_name || chr(10) || chr(10) || '[brand]' || chr(10) || p_brand as parts from part where p_name <> '' and p_brand <> '' and p_type <> ''""")
def names_and_labels(spark, d):
    """Words in brackets, page numbers in image names, image names, bullets and named sections."""
    p = table(spark, d, "part").where("p_name <> '' and p_brand <> '' and p_type <> ''")
    title = F.concat(F.lit("x ("), "p_type", F.lit(") y （"), F.col("p_size").cast("string"), F.lit("）"))
    marks = T.bracketed(title)
    page = F.pmod(F.col("p_partkey"), F.lit(50))
    shown = F.concat(F.lit("scan_Page-"), page.cast("string"), F.lit(".JPG"))
    return p.select(
        "p_partkey", F.concat(F.array_join(marks, "|"), F.lit("）")).alias("marks"), R.image_page(shown).cast("long").alias("page"),
        R.image_name(F.lit("img"), page.cast("int"), (F.col("p_size") % 1000).cast("int"), F.lit("png")).alias("name"),
        T.bullets(F.array("p_name", "p_brand")).alias("points"), R.sections(title=F.col("p_name"), none=F.lit(""), brand=F.col("p_brand")).alias("parts"),
    )


@query("""with s as (select n_regionkey, n_nationkey, '## ' || n_nationkey || '. ' || n_name || chr(10) || chr(10) || '- ' || n_name || case when n_nationkey % 2 = 0 then chr(10) || chr(10) || '![](' || n_name || '.png)' else '' end
      || case when n_nationkey % 3 = 0 then chr(10) || chr(10) || '> one' || chr(10) || '> two' else '' end as slide from nation)
    select r_name, string_agg(slide, chr(10) || chr(10) order by n_nationkey) as body from s join region on n_regionkey = r_regionkey group by r_name""")
def slide_decks(spark, d):
    """Regions as decks, a slide for each nation."""
    none = F.array().cast("array<string>")
    slide = F.struct(
        F.col("n_nationkey").cast("int").alias("slide_num"), F.col("n_name").alias("title"), F.array(F.concat(F.lit("- "), "n_name")).alias("content"),
        F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat("n_name", F.lit(".png")))).otherwise(none).alias("images"), F.when(F.col("n_nationkey") % 3 == 0, "one\ntwo").otherwise("").alias("notes"),
    )
    decks = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(slide)).alias("slides"))  # of one region each
    return decks.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", R.slides_markdown(F.col("slides")).alias("body"))


@query("""select conv_id, turn, case when turn % 2 = 0 then text else '' end as problem, case when turn % 2 = 0 then 5 else 0 end::bigint as n_points, case when turn % 2 = 0 then 0 else 1 end::bigint as n_concepts,
    case when turn % 3 = 0 then role || ',' || role || '!' end as asked from conversations""")
def summary_replies(spark, d):
    """Turns as replies with a summary card, of which fields are missing, and with a list of questions."""
    c = table(spark, d, "conversations")
    some = F.to_json(F.struct(F.col("text").alias("problem"), F.array_repeat(F.col("role"), 7).alias("contributions")))
    other = F.to_json(F.struct(F.array("role").alias("concepts"), F.lit("m").alias("method")))
    s = R.summary(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), some, F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), other)))
    listed = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Here: "), F.to_json(F.array("role", F.concat("role", F.lit("!")))), F.lit(" done"))).otherwise(F.lit("no list"))
    return c.select("conv_id", "turn", s.alias("s"), T.json_strings(listed).alias("q")).select(
        "conv_id", "turn", F.col("s.problem").alias("problem"), F.size("s.contributions").cast("long").alias("n_points"), F.size("s.concepts").cast("long").alias("n_concepts"), F.array_join("q", ",").alias("asked")
    )


@query("""select '/out/o' || o_orderkey || '_1' || lpad((o_orderkey % 1000000000)::varchar, 9, '0') || '/full.md' as source, 'o' || o_orderkey as name, 1000000000 + o_orderkey % 1000000000 as ts,
    case when o_orderstatus = 'F' then 'indexed' else 'pending' end as status from orders where o_orderstatus <> 'P'""")
def output_folders(spark, d):
    """Orders as folders of a parser's output, closed ones indexed; those pending have another name."""
    o = table(spark, d, "orders")
    stamp = F.concat(F.lit("_1"), F.lpad((F.col("o_orderkey") % 1000000000).cast("string"), 9, "0"))
    path = F.concat(F.lit("/out/o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", "").otherwise(stamp), F.lit("/full.md"))
    paths = o.select(path.alias("source"), "o_orderstatus")
    return files.output_dirs(paths, paths.where("o_orderstatus = 'F'")).select("source", "name", "ts", "status")


@query(r"""select trim(regexp_replace(p_name || '/' || p_partkey, '[^\p{L}\p{N} _-]', '', 'g')) || '.md' as file_name, '---' || chr(10) || 'title: "' || p_name || '/' || p_partkey || '"' || chr(10) || 'source: ' || p_brand || chr(10) || 'tags: [' || p_type || ', x]' || chr(10) || '---' || chr(10)
    || '# ' || p_name || '/' || p_partkey || chr(10) || chr(10) || case when p_size % 2 = 0 then '- ' || p_size else '- (none)' end || chr(10) || chr(10) || p_type || chr(10) as content from part""")
def written_notes(spark, d):
    """Parts as notes to write: safe file names, front matter, bullets or a placeholder."""
    p = table(spark, d, "part")
    return sinks.note_texts(p.select(
        F.concat_ws("/", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_brand").alias("url"), F.array("p_type", F.lit("x")).alias("tags"),
        F.when(F.col("p_size") % 2 == 0, F.array(F.col("p_size").cast("string"))).otherwise(F.array().cast("array<string>")).alias("points"), F.col("p_type").alias("body"),
    ))


@query("""select p_partkey, '来源: ' || p_brand || ' | 小节: ' || p_type || ' | 标签: a, ' || p_name || case when p_size % 2 = 0 then ', c' else '' end as prefix from part where p_type <> ''""")
def chunk_prefix_tags(spark, d):
    """Prefixes of chunks under a second heading, with two to four tags."""
    tags = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("a"), F.col("p_name"), F.lit("c"), F.lit("d"))).otherwise(F.array(F.lit("a"), F.col("p_name")))
    p = table(spark, d, "part").where("p_type <> ''")
    return p.select("p_partkey", S.prefix(F.col("p_brand"), F.col("p_brand"), F.col("p_type"), F.lit(""), tags).alias("prefix"))


@query(r"""with recursive w as (
      select doc_id, 0 as pos, 0 as start, text from documents where text <> ''
      union all select doc_id, pos + 1, start + size - 200, text from (select *, case when start + 2000 < length(text) and stop > 1000 then stop else length(substring(text, start + 1, 2000)) end as size
        from (select *, length(regexp_extract(substring(text, start + 1, 2000), '(?s)^(.*[。？！.])', 1)) as stop from w)) where start + 2000 < length(text)),
    s as (select doc_id, pos, start, text, length(regexp_extract(substring(text, start + 1, 2000), '(?s)^(.*[。？！.])', 1)) as stop from w)
    select doc_id, pos, substring(text, start + 1, case when start + 2000 < length(text) and stop > 1000 then stop else 2000 end) as chunk from s""")
def sliding_texts(spark, d):
    """Overlapping windows of 2000 characters, cut behind a full stop."""
    c = texts(spark, d).select("doc_id", F.posexplode(S.sliding(F.col("text"))).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(r"""with recursive l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as n from documents where text is not null),
    p as (select doc_id, row_number() over (partition by doc_id order by n) as i, regexp_replace(raw, '^\s+|\s+$', '', 'g') as part from l where regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
    g as (select doc_id, i, part, 1 as grp, case when length(part) > 320 then -1 else length(part) end as len from p where i = 1
      union all select p.doc_id, p.i, p.part, case when length(p.part) > 320 or g.len < 0 or g.len + length(p.part) > 320 then g.grp + 1 else g.grp end,
        case when length(p.part) > 320 then -1 when g.len < 0 or g.len + length(p.part) > 320 then length(p.part) else g.len + length(p.part) end from g join p on p.doc_id = g.doc_id and p.i = g.i + 1),
    h as (select doc_id, grp, 0 as k, 0 as start, part from g where len < 0
      union all select doc_id, grp, k + 1, start + size, part from (select *, case when start + 320 < length(part) and after > 0 then 300 + after else length(substring(part, start + 1, 320)) end as size
        from (select *, length(regexp_extract(substring(part, start + 301, 20), '(?s)^(.*[。！？；.!?;])', 1)) as after from h)) where start + size < length(part)),
    c as (select doc_id, grp, 0 as k, string_agg(part, chr(10) || chr(10) order by i) as chunk from g where len >= 0 group by doc_id, grp
      union all select doc_id, grp, k, regexp_replace(substring(part, start + 1, case when start + 320 < length(part) and after > 0 then 300 + after else 320 end), '^\s+|\s+$', '', 'g')
        from (select *, length(regexp_extract(substring(part, start + 301, 20), '(?s)^(.*[。！？；.!?;])', 1)) as after from h))
    select doc_id, row_number() over (partition by doc_id order by grp, k) - 1 as pos, chunk from c""")
def packed_paragraphs(spark, d):
    """Documents, a paragraph a line, packed greedily into chunks of 320 characters; longer ones are cut behind a mark."""
    parts = T.strip(F.regexp_replace("text", "\n", "\n\n"))
    c = texts(spark, d).select("doc_id", F.posexplode(S.packed(S.paragraphs(parts), S.max_chars())).alias("pos", "chunk"))
    return c.select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(r"""with s as (select conv_id, turn, role as h2, regexp_replace(text, '^\s+|\s+$', '', 'g') as body from conversations),
    c as (select conv_id, h2, body, row_number() over (partition by conv_id order by turn) as i from s where body <> ''),
    f as (select *, case when i > 1 and length(body) < 100 and h2 = lag(h2) over (partition by conv_id order by i) then 0 else 1 end as opens from c),
    g as (select *, sum(opens) over (partition by conv_id order by i) as grp from f)
    select conv_id, (grp - 1)::bigint as pos, any_value(h2) as h2, string_agg(body, chr(10) || chr(10) order by i) as body from g group by conv_id, grp""")
def merged_sections(spark, d):
    """Turns as sections; one under a hundred characters joins the one before if it has the same heading."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # of one conversation each
    section = F.transform("t", lambda x: F.struct(F.lit("").alias("h1"), x["role"].alias("h2"), T.strip(x["text"]).alias("body")))
    c = turns.select("conv_id", F.posexplode(S.merged_short(F.filter(section, lambda s: s["body"] != ""), 100)).alias("pos", "c"))
    return c.select("conv_id", F.col("pos").cast("long").alias("pos"), "c.h2", "c.body")


@query(rf"""with items as (select item_id as query_id, text as query from benchmark where item_id % 20 = 0),
    s as (select 'conv' || conv_id || '#' || turn as id, 'conv' || conv_id as source, regexp_replace(text, '^\s+|\s+$', '', 'g') as body from conversations),
    b as (select id, source, body, {_tok('body')} as words from s where body <> ''),
    st as (select count(*) as n_docs, avg(len(words)) as avg_len from b),
    t as (select id, term, count(*) as tf, any_value(n) as n from (select id, unnest(words) as term, len(words) as n from b) group by id, term),
    q as (select distinct query_id, term from (select query_id, unnest({_tok('query')}) as term from items)),
    df as (select term, count(*) as df from t group by term),
    x as (select query_id, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * n / avg_len))), 6) as score from q join t using (term) join df using (term), st group by query_id, id),
    r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from x),
    p as (select query_id, rank, '[' || rank || '] ' || source || chr(10) || body as part from r join b using (id) where rank <= 3)
    select query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank) as context, count(*) as n_used from p group by query_id""")
def notes_to_context(spark, d):
    """From Markdown to cited context: conversations as notes, cut at headings, indexed, searched for benchmark items, and the best three joined."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))  # of one conversation each
    note = F.concat(F.lit("# note\n"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["turn"].cast("string"), F.lit("\n"), x["text"])), "\n"))
    notes = turns.select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("source"), note.alias("content"))
    chunks = notes.select("source", F.explode(S.by_headings(F.col("content"), F.col("source"))).alias("c")).select(F.concat_ws("#", "source", "c.h2").alias("id"), "source", F.col("c.body").alias("raw_text"))
    index = TextIndex(spark, new_folder(spark, "notes-index"), "id")
    index.add(chunks, "raw_text")
    hits = index.search(item_queries(spark, d), 3).join(chunks, "id").withColumns({"chunk_type": F.lit("text"), "page": F.lit(0)})
    return context.build(hits, 1_000_000).select("query_id", "context", "n_used")


@query(rf"""with recursive words as (select unnest({_tok('text')}) as word from documents), dict as (select word, count(*)::double as freq from words group by word),
    tot as (select sum(freq) as total, max(length(word)) as longest from dict),
    pr as (select page_id, unnest(regexp_extract_all(lower(coalesce(url, '')), '\p{{L}}+|\p{{N}}+')) as run, generate_subscripts(regexp_extract_all(lower(coalesce(url, '')), '\p{{L}}+|\p{{N}}+'), 1) as pos from pages),
    rr as (select distinct run, length(run) as n from pr where regexp_matches(run, '^\p{{L}}')),
    st as (select run, n, unnest(range(n)) as place from rr),
    pt as (select run, place, unnest(range(1, least(longest, n - place) + 1)) as size from st, tot),
    ed as (select run, list(struct_pack(place := place, size := size, weight := ln(freq / total))) as edges from pt join dict on word = substring(run, place + 1, size), tot group by run),
    g as (select rr.run, n, coalesce(edges, []) as edges, ln(1.0::double / total) as low from rr left join ed using (run), tot),
    f as (select run, n, edges, low, n as i, []::struct(score double, size bigint)[] as done from g
      union all select run, n, edges, low, i - 1, list_prepend(list_reverse_sort(list_transform(own, lambda e: struct_pack(score := e.weight + case when e.size > len(done) then 0.0::double else done[e.size].score end, size := e.size)))[1], done)
      from (select *, case when len(list_filter(at_it, lambda e: e.size = 1)) > 0 then at_it else list_append(at_it, struct_pack(place := i - 1, size := 1::bigint, weight := low)) end as own
        from (select *, list_filter(edges, lambda e: e.place = i - 1) as at_it from f where i > 0))),
    b as (select run, edges, done from f where i = 0),
    k as (select run, edges, done, 0::bigint as place from b union all select run, edges, done, place + done[place + 1].size from k where place + done[place + 1].size < len(done)),
    w as (select run, edges, place, done[place + 1].size as size from k),
    j as (select run, string_agg(word, ' ' order by place, kind, sub) as joined from ({{}}) group by run)
    select page_id, coalesce(string_agg(coalesce(joined, pr.run), ' ' order by pos), '') as words from pages left join pr using (page_id) left join j on j.run = pr.run group by page_id""".replace("{}", """
      select run, place, 9 as kind, 0::bigint as sub, substring(run, place + 1, size) as word from w
      union all select run, place, kind, sub, substring(run, sub + 1, kind) from (select run, edges, place, size, kind, unnest(range(place, place + size - kind + 1)) as sub from w, (values (2), (3)) t(kind) where size > kind)
        where len(list_filter(edges, lambda e: e.place = sub and e.size = kind)) > 0"""))
def segmented_addresses(spark, d):
    """Letters of addresses cut into words that documents have."""
    docs = table(spark, d, "documents")
    dictionary = docs.select(F.explode(T.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    s = segment.segmented(table(spark, d, "pages"), "page_id", "url", dictionary, pattern=r"\p{L}+")
    return s.select("page_id", F.array_join("words", " ").alias("words"))
