"""Fixture bindings: expressions and decision rules.

Rules over words no fixture column holds get their input by row: each table row
picks one value of a list by its key, and the SQL side picks the value the rule
must give.  The rows, and so the work, are those of the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import rules as R
from shelfspark.functions import text as X
from shelfspark.functions import vocab as V
from shelfspark.operators import audit, filters
from shelfspark.plans.registry import query


def pick(values, key):
    options = F.array(*[F.lit(v).cast("string") for v in values])
    return F.get(options, F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def literal(v):
    if v is None:
        return "null::varchar"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + v.replace("'", "''") + "'"


def sql_pick(values, key):
    return "[" + ", ".join(literal(v) for v in values) + f"][({key}) % {len(values)} + 1]"


# --- folding, codes, dates ------------------------------------------------------------------

@query("fold_text", """
select doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'))) as spaced,
       md5(trim(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', '', 'g'))) as dropped from documents""")
def fold_text(t):
    return t.documents.select("doc_id", F.md5(X.fold_text("text")).alias("spaced"),
                              F.md5(X.fold_text("text", "drop")).alias("dropped"))


@query("isbn13", """
with b as (select l_orderkey, l_linenumber, '978' || lpad((l_orderkey * 7919 + l_linenumber)::varchar, 9, '0') as s from lineitem),
 w as (select *, list_sum(list_transform(range(1, 13), lambda i: substr(s, i, 1)::int * (case when i % 2 = 1 then 1 else 3 end))) as total from b)
select l_orderkey, l_linenumber, s || ((10 - total % 10) % 10)::varchar as ean from w""")
def isbn13(t):
    nine = F.lpad((F.col("l_orderkey") * 7919 + F.col("l_linenumber")).cast("string"), 9, "0")
    return t.lineitem.select("l_orderkey", "l_linenumber", X.isbn10_to_ean13(F.concat(nine, F.lit("X"))).alias("ean"))


@query("choose_identifier", """
select o_orderkey, case o_orderkey % 5
  when 0 then lpad(o_orderkey::varchar, 13, '1') when 1 then lpad(o_orderkey::varchar, 13, '2')
  when 2 then '9782070541270' when 3 then '12345' else 'CB:B' || o_orderkey end as identifier from orders""")
def choose_identifier(t):
    k, text = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    ean = F.when(k == 0, F.lpad(text, 13, "1")).when(k == 3, "123-45")
    isbn = F.when(k == 1, F.lpad(text, 13, "2")).when(k == 2, "2-07-054127-4").when(k == 3, "99")
    return t.orders.select("o_orderkey", X.choose_identifier(ean, isbn, F.concat(F.lit("B"), text)).alias("identifier"))


NUMBERS = ("12", "7.9", "", "Aucune donnée disponible", "-Non Précisé-", " 40 ", None)
DATES = ("03/02/2024 10:05", "31/12/1999", "2024-01-01", "", None)
YEARS = ("2024", "2019-05-01", "DL 2026", "sans date", "[1987]", None)
DAYS = ("20240105", "2024010", "20240105X", "abcd", None)


@query("parsed_values", f"""
select o_orderkey, {sql_pick((12, 7, None, None, None, 40, None), 'o_orderkey').replace('null::varchar', 'null')}::bigint as whole,
 {sql_pick(('2024-02-03 10:05', '1999-12-31', None, None, None), 'o_orderkey')} as moment,
 {sql_pick(('2024', '2019', '2026', None, '1987', None), 'o_orderkey')} as year,
 {sql_pick(('2024-01-05', None, '2024-01-05', None, None), 'o_orderkey')} as day,
 {sql_pick(('9781234567890', None, None, '9781234567890'), 'o_orderkey')} as ean from orders""")
def parsed_values(t):
    key = "o_orderkey"
    return t.orders.select(
        key, X.safe_int(pick(NUMBERS, key)).alias("whole"), X.fr_datetime(pick(DATES, key)).alias("moment"),
        X.pub_year(pick(YEARS, key)).alias("year"), X.yyyymmdd(pick(DAYS, key)).alias("day"),
        X.valid_ean(pick(("9781234567890", "978123", "97812345678AB", "9781234567890.0"), key)).alias("ean"))


@query("names_and_marks", f"""
select p_partkey, {sql_pick(('BDJ', 'R', '(sans cote)', '(sans cote)', 'JV'), 'p_partkey')} as zone,
 {sql_pick(('Thorgal', 'Lucky Luke', 'Naruto', None), 'p_partkey')} as series,
 {sql_pick(('a.n.g.e', 'max et lili', 'tintin'), 'p_partkey')} as series_key,
 {sql_pick(('Nolan, Christopher', 'Bird', ''), 'p_partkey')} as first_author,
 {sql_pick(('NOL', 'BIR', None, 'LY', 'GON'), 'p_partkey')} as letters,
 {sql_pick(('https://x.org/list-5/prix-2024/', 'https://x.org/a/', 'https://x.org/b/'), 'p_partkey')} as url,
 {sql_pick(('12', None, '16'), 'p_partkey')} as pegi from part""")
def names_and_marks(t):
    key = "p_partkey"
    return t.part.select(
        key, X.shelf_zone(pick(("BDJ 741", "r dic", "", "741", "JV 3"), key)).alias("zone"),
        X.series_name(pick(("Thorgal / Rosinski", "Lucky Luke [BD]", "Naruto", None), key)).alias("series"),
        X.series_key(pick(("A.N.G.E.", " Max et Lili .", "TINTIN"), key)).alias("series_key"),
        X.author_first(pick(("Nolan, Christopher ; Zimmer", "Bird;x", ""), key)).alias("first_author"),
        X.director_letters(pick(("Nolan, Christopher", "Bird (Brad)", "O", "Ly, Ladj", "Göncourt / X"), key)).alias("letters"),
        X.canonical_url(pick(("https://x.org/list-5/prix-2024/?page=2", "https://x.org/a#top", "https://x.org/b/"), key)).alias("url"),
        X.clean_pegi(pick(("PEGI 12", "tous", "16"), key)).alias("pegi"))


@query("word_present", r"""
select doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])eau([^\p{L}\p{N}_]|$)') as eau,
       regexp_matches(text, '(^|[^\p{L}\p{N}_])the([^\p{L}\p{N}_]|$)') as the from documents""")
def word_present(t):
    return t.documents.select("doc_id", X.word_present("eau", "text").alias("eau"), X.word_present("the", "text").alias("the"))




@query("token_similarity", """
with p as (select conv_id, turn, lag(text) over (partition by conv_id order by turn) as before, text from conversations),
 d as (select conv_id, turn, list_filter(list_distinct(string_split(regexp_replace(lower(strip_accents(before)), '[^a-z0-9 ]', '', 'g'), ' ')), lambda w: w <> '') as a,
   list_filter(list_distinct(string_split(regexp_replace(lower(strip_accents(text)), '[^a-z0-9 ]', '', 'g'), ' ')), lambda w: w <> '') as b,
   list_filter(list_distinct(string_split(regexp_replace(lower(strip_accents(before)), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda w: w <> '') as c,
   list_filter(list_distinct(string_split(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda w: w <> '') as e
   from p where before is not null)
select conv_id, turn, coalesce(round(case when len(a) = 0 or len(b) = 0 then 0.0 else len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) end, 6), 0)::double as jaccard,
  coalesce(round(case when len(c) = 0 or len(e) = 0 then 0.0 else len(list_intersect(c, e)) / greatest(len(c), len(e)) end, 6), 0)::double as overlap from d""")
def token_similarity(t):
    """Each turn against the turn before it."""
    turns = t.conversations.select("conv_id", "turn", "text")
    prior = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = turns.join(prior, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.round(X.token_jaccard("before", "text"), 6).alias("jaccard"),
                       F.round(X.token_overlap_max("before", "text"), 6).alias("overlap"))


# --- audiences, genres, collections ---------------------------------------------------------------

AUDIENCE_IN = ("Jeune", "Jeunesse", "JEUNE ", "Adulte", "Ado (12+)", "Adolescent", "Ados / Adultes", "Tout public",
               "Dès 3 ans", "8-12 ans", "à partir de 8", "dès 9 ans", "Dès 12 ans", "", None, "Public inconnu bizarre")
AUDIENCE_OUT = ("Jeunesse", "Jeunesse", "Jeunesse", "Adulte", "Adolescent", "Adolescent", "Tout public", "Tout public",
                "Jeunesse", "Jeunesse", "Jeunesse", "Jeunesse", "Adolescent", "", None, "Public inconnu bizarre")


@query("audience_rule", f"""
select o_orderkey, {sql_pick(AUDIENCE_OUT, 'o_orderkey')} as audience, o_orderkey % 16 between 8 and 11 as is_age from orders""")
def audience_rule(t):
    raw = pick(AUDIENCE_IN, "o_orderkey")
    return t.orders.select("o_orderkey", R.normalise_audience(raw).alias("audience"), R.age_in_audience(raw).alias("is_age"))


@query("move_age", f"""
select o_orderkey, {sql_pick(AUDIENCE_OUT, 'o_orderkey')} as audience,
 case when o_orderkey % 3 = 0 then '6' when o_orderkey % 16 between 8 and 11 then {sql_pick(AUDIENCE_IN, 'o_orderkey')} end as age from orders""")
def move_age(t):
    df = t.orders.select("o_orderkey", pick(AUDIENCE_IN, "o_orderkey").alias("audience"),
                         F.when(F.col("o_orderkey") % 3 == 0, "6").alias("age"))
    return R.move_age_then_normalise(df, "audience", "age")


@query("manga_audience", f"""
select p_partkey, {sql_pick(('Adulte', 'Jeunesse', 'Jeunesse', 'Adulte', 'Adolescent'), 'p_partkey')} as audience from part""")
def manga_audience(t):
    return t.part.select("p_partkey", R.manga_audience(
        pick(("PEGI 16", "12", "PEGI 7", "14", None), "p_partkey"), F.lit("Ado (12+)")).alias("audience"))


GENRE_IN = ("Romance", "Histoire / Aventure", "Amour/Romance", "Documentaire / Histoire", "Policier", "Science  Fiction",
            "", None, "Humour / Humour")
GENRE_OUT = ("Amour / Romance", "Historique / Aventure", "Amour / Romance", "Documentaire / Historique", "Policier / Mystère",
             "Science-fiction", "", None, "Humour")
GENRE_WHY = ("« Romance » -> paire « Amour / Romance »", "« Histoire » -> « Historique »",
             "« Amour » -> paire « Amour / Romance » ; « Romance » -> paire « Amour / Romance » ; doublon retiré",
             "« Documentaire » double la colonne categorie : à trancher ; « Histoire » -> « Historique »",
             "« Policier » -> paire « Policier / Mystère »", "« Science  Fiction » -> « Science-fiction »", "", "",
             "doublon retiré")


SERIES_CASES = (
    ("Corto Maltese", "3", "series"), ("Les Aventures de Tintin", "7", "series"), ("Ainsi va la vie.", "125", "series"),
    ("Max et Lili", None, "series"), ("Collection Folio", None, "collection"), ("Folio junior", None, "collection"),
    ("Aire Libre", None, "collection"), ("Grand angle", None, "collection"), ("10-18", None, "collection"),
    ("Albums", None, "collection"), ("Jeunesse", None, "collection"), ("7", None, "collection"),
    ("Collection dirigée par Emmanuelle Beulque", None, "collection"), ("Kididoc", "43", "numbered"),
    ("Best of Marvel", None, "collection"), ("Yoko Tsuno", "12", "series"), ("Lucky Luke", "37", "series"),
    ("Médium (Paris. 1", None, "authority"), ("Roman (Éd. de la Loupe", None, "authority"), ("Mouche (Paris", "3", "authority"),
    ("Achille Talon", "5", "series"), ("A.N.G.E", None, "series"), ("Thorgal", "22", "series"), (None, "4", "empty"))


STRICT_CASES = (("Seuls, tome 8", "Seuls", "8"), ("Seuls 8", None, None), ("Naruto - T.12", "Naruto", "12"),
                ("Akira vol. 3", "Akira", "3"), ("1,2,3... Nagasaki", None, None), ("Thorgal : tome n° 5", "Thorgal", "5"))


# --- detection ------------------------------------------------------------------------------------------

AUDIENCE_CASES = (
    # code, title, collection, publisher, age, audience
    ("", "x", "", "", "dès 6 ans", "Dès 6 ans"), ("j", "x", "", "", "", "Jeunesse"), ("", "x", "Folio junior", "", "", "8-12 ans"),
    ("", "x", "", "Éditions Kaléidoscope", "", "Dès 3 ans"), ("", "Le livre des ados", "", "", "", "Ado (12+)"),
    ("", "Contes", "", "", "", ""), ("", "x", "", "Pika", "12 à 15", "Ado (12+)"), ("", "x", "", "Ki-oon", "", "Ado (12+)"),
    ("d", "x", "Scripto", "", "", "Adulte"), ("", "x", "", "", "8 à 10 ans", "8-12 ans"), ("", "x", "", "", "lycée", "Ado (12+)"),
    ("", "x", "", "", "99", "99"))


TYPE_CASES = (
    # title, collection, abstract, support, publisher, audience, type
    ("x", "", "", "", "Glénat Manga", "", "Manga"), ("x", "", "", "", "Glénat", "", "BD"), ("x", "Scripto", "", "", "", "", "Roman ado / YA"),
    ("Mon imagier", "", "", "", "", "", "Album"), ("x", "", "un roman jeunesse", "", "", "Ado (12+)", "Roman ado / YA"),
    ("x", "", "un roman jeunesse", "", "", "", "Roman jeunesse"), ("x", "", "", "Texte imprimé", "", "Ado", "Roman ado / YA"),
    ("x", "", "", "Texte imprimé", "", "", "Roman jeunesse"), ("x", "", "", "", "", "", ""), ("Atlas du ciel", "", "", "", "", "", "Documentaire"))


PEGI_CASES = (("Manga", "Ado (12+)", "", "12"), ("Album", "Ado (12+)", "PEGI 16", ""), ("BD", "", "noté pegi 18", "18"),
              ("Manga", "", "", "12"), ("BD", "8-12 ans", "", "7"), ("BD", "", "", ""), ("Manga", "16 ans", "", "16"))


def genre_sql() -> str:
    """Every genre word searched for in the heading (first line) and in the text:
    plain words among the words of the text, expressions by pattern."""
    plain, parts = [], []
    edge = r"[^\p{L}\p{N}_]"
    for i, (g, words) in enumerate(V.GENRE_WORDS):
        for w in map(str.strip, words):
            if w.isalnum():
                plain.append(f"({i}, {literal(g)}, {literal(w)})")
            else:
                pattern = literal(f"(^|{edge}){w}({edge}|$)")
                parts.append(f"select doc_id, {i}, {literal(g)}, regexp_matches(head, {pattern}) from d "
                             f"where contains(body, {literal(w)}) and regexp_matches(body, {pattern})")
    return f"""
with w(rank, genre, word) as (values {', '.join(plain)}),
 d as (select doc_id, lower(split_part(text, chr(10), 1)) as head, lower(text) as body from documents),
 tok as (select doc_id, regexp_extract_all(head, '[\\p{{L}}\\p{{N}}_]+') as heads,
         unnest(list_distinct(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+'))) as word from d),
 hits(doc_id, rank, genre, titled) as (
   select doc_id, rank, genre, list_contains(heads, word) from tok join w using (word)
   union all {' union all '.join(parts)}),
 s as (select doc_id, rank, genre, sum(case when titled then 3 else 1 end) as score from hits group by 1, 2, 3),
 r as (select *, row_number() over (partition by doc_id order by score desc, rank) as place from s)
select doc_id, coalesce(string_agg(genre, ' / ' order by place) filter (place <= 2), '') as genre
from d left join r using (doc_id) group by doc_id"""


@query("score_genres", genre_sql())
def score_genres(t):
    head = F.get(F.split("text", "\n"), F.lit(0))
    return t.documents.select("doc_id", R.score_genres(head, F.lit(""), "text", F.lit(""), F.lit("")).alias("genre"))


GENRE_TEXTS = (("Le dragon de l'école", "magie et guerre", "Fantastique / Vie quotidienne"), ("Alchimie", "enjeu jeune", ""),
               ("x", "la science-fiction spatiale, un robot", "Science-fiction"), ("Jeu vidéo", "musique", "Cuisine / Activités / Arts / Musique"),
               ("Goûters philo", "amour", "Philo / Société / Amour / Romance"), ("Foot", "football tennis", "Sport"))


@query("genre_words", f"select o_orderkey, {sql_pick([c[2] for c in GENRE_TEXTS], 'o_orderkey')} as genre from orders")
def genre_words(t):
    return t.orders.select("o_orderkey", R.score_genres(
        pick([c[0] for c in GENRE_TEXTS], "o_orderkey"), F.lit(""), pick([c[1] for c in GENRE_TEXTS], "o_orderkey"),
        F.lit(""), F.lit("")).alias("genre"))


PUBLISHERS = (("Editions Dupuis.", "Dupuis"), ("Gallimard-Jeunesse", "Gallimard Jeunesse"), ("éditions glénat", "Glénat"),
              ("Delcourt;", "Delcourt"), ("Hachette Roman Poche", "Hachette"), ("Actes Sud", "Actes Sud"))


@query("dictionary_contains", """
select p_partkey, case when contains(p_name, 'ring') then 'jewel' when contains(p_name, 'red') then 'colour'
  when contains(p_name, 'plate') then 'metal' end as label from part""")
def dictionary_contains(t):
    return t.part.select("p_partkey", R.first_contained(
        F.col("p_name"), (("ring", "jewel"), ("red", "colour"), ("plate", "metal"))).alias("label"))


# --- records ----------------------------------------------------------------------------------------------

SUBJECTS = (("Bandes dessinées", "Humour"), ("Romans", "Policier"), ("Histoire", "Géographie", "Arts"), ("Inconnu",),
            ("Romans",), ("Mangas", "Polar", "Thriller", "Fantasy"))
SUBJECT_AUDIENCES = ("Jeunesse", "Adulte", "Adulte", "Adulte", "Adolescent", "Adolescent")


@query("record_roles", """
with first as (select l_orderkey, l_linenumber % 3 as role, min(l_linenumber * 100000 + l_suppkey) as k from lineitem group by 1, 2)
select l_orderkey, max(case when role = 1 then 'S' || (k % 100000) end) as author,
       max(case when role = 2 then 'S' || (k % 100000) end) as illustrator,
       coalesce(max(case when role = 1 then 'S' || (k % 100000) end), 'S' || (min(k) % 100000)) as shown from first group by 1""")
def record_roles(t):
    """Lines of an order as contributors.  Only the first of each role can be
    named, so an order is cut to one contributor per role before the array."""
    line = F.col("l_linenumber")
    role = F.when(line % 3 == 1, "070").when(line % 3 == 2, "440").otherwise("730")
    people = t.lineitem.select("l_orderkey", role.alias("role"), F.struct(
        (line * 100000 + F.col("l_suppkey")).alias("k"), role.alias("role"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name")).alias("p"))
    firsts = people.groupBy("l_orderkey", "role").agg(F.min("p").alias("p"))
    df = firsts.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("people"))
    return df.select("l_orderkey", R.resolve_author("people").alias("author"), R.role_holder("people", "440").alias("illustrator"),
                     R.resolve_author("people", display=True).alias("shown"))


@query("series_precedence", """
select p_partkey, case p_partkey % 5 when 0 then p_name when 1 then 'Linked' when 2 then 'Linked' when 3 then 'Coll' end as series,
 case p_partkey % 5 when 0 then p_size::varchar when 1 then '4' when 3 then '9' end as volume,
 case p_partkey % 4 when 0 then 'REVUE' when 1 then 'CD' when 2 then 'LIVRE' else 'AUTRE' end as kind from part""")
def series_precedence(t):
    k, q = F.col("p_partkey") % 5, F.col("p_partkey") % 4
    s = R.series_by_precedence(
        "p_name", F.when(k == 0, F.col("p_size").cast("string")), F.when(k.isin(1, 2), "Linked / x"), F.when(k == 1, "4"),
        F.when(k.isin(3, 4), "Coll [y]"), F.lit("9"), k == 3)
    kind = R.document_type(F.when(q == 0, "2020"), F.when(q == 1, "Cassette").when(q == 2, "Imprimé").otherwise("?"))
    df = t.part.select("p_partkey", s.alias("s"), kind.alias("kind"))
    return df.select("p_partkey", "s.series", "s.volume", "kind")


@query("game_figures", """
select p_partkey, 'dès ' || p_size || ' ans' as age, case when p_size % 3 > 0 then p_size end as most,
       case when p_size % 2 = 0 then 'B' end as duration from part""")
def game_figures(t):
    size = F.col("p_size")
    def field(code, label, scheme):
        return F.struct(code.alias("code"), label.alias("label"), scheme.alias("scheme"))
    text, none = size.cast("string"), F.lit(None).cast("string")
    fields = F.array(
        field(F.lit("a1"), F.concat(F.lit("dès "), text, F.lit(" ans")), F.lit("Age des joueurs")),
        field(F.when(size % 3 > 0, text).otherwise("many"), F.lit("Nombre de joueurs maximum"), none),
        field(F.lit("B"), none, F.when(size % 2 == 0, "Durée moyenne de la partie").otherwise("other")))
    df = t.part.select("p_partkey", fields.alias("f"))
    return df.select("p_partkey", R.game_value("f", "players_age").alias("age"),
                     R.game_value("f", "players_max", whole=True).alias("most"), R.game_value("f", "duration").alias("duration"))


# --- suggestions, matching, weeding -----------------------------------------------------------------------------

SUGGESTED = (
    ("Manga shonen", "", "", "Manga", "Tout public", "À préciser"), ("Un roman policier", "ados", "", "Roman", "Adolescent", "Policier"),
    ("x", "", "Veille jeunesse", "À classer", "Jeunesse", "À préciser"), ("Album des petits", "fantasy", "", "Album", "Jeunesse", "Fantastique"),
    ("Atlas", "", "autre", "Documentaire", "Tout public", "À préciser"))


@query("match_confidence", """
select l_orderkey, l_linenumber, l_partkey, case when l_quantity / 50 >= 0.8 and (l_discount * 10 >= 0.4 or l_returnflag = 'A') then 'élevée'
  when l_quantity / 50 >= 0.5 then 'moyenne' when l_linestatus = 'F' then 'faible' else '—' end as confidence from lineitem""")
def match_confidence(t):
    c = R.match_confidence(F.col("l_quantity") / 50, F.col("l_discount") * 10,
                           F.when(F.col("l_returnflag") != "A", "x"), F.when(F.col("l_linestatus") == "F", "x"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", c.alias("confidence"))


@query("confidence_order", """
select o_orderkey, row_number() over (order by o_orderkey % 4, o_orderkey) as place from orders""")
def confidence_order(t):
    df = t.orders.select("o_orderkey", pick(("élevée", "moyenne", "faible", "—"), "o_orderkey").alias("c"))
    return filters.placed(df, filters.by_confidence("c", "o_orderkey")).select("o_orderkey", "place")


@query("provenance", """
select p_partkey, case when p_size % 2 = 0 and p_size % 3 = 0 then 'serie,tome' when p_size % 2 = 0 then 'serie'
  when p_size % 3 = 0 then 'tome' end as marker, case when p_size < 20 then 'manga' when p_size < 30 then 'bd'
  when p_size < 40 then 'roman_ado' end as hint, p_size % 5 = 1 as excluded from part""")
def provenance(t):
    size = F.col("p_size")
    marker = R.provenance_marker(serie=(F.when(size % 2 != 0, "a"), F.lit("n")), tome=(F.lit(""), F.when(size % 3 == 0, "3")))
    hint = R.category_hint(F.when(size < 20, "Mangas").when(size < 30, "bande dessinée").when(size < 40, "Romans"), F.lit("Adolescent"))
    excluded = R.title_excluded(F.when(size % 5 == 1, "Pack 10 ex").otherwise("Intérieur")) & ~R.support_excluded(F.lit("Poche"))
    return t.part.select("p_partkey", marker.alias("marker"), hint.alias("hint"), excluded.alias("excluded"))


COMICS = (("BD Kids", "x", True, False), ("Kana", "x", False, True), ("Dupuis", "x", True, False), ("Urban Comics", "Batman", False, True),
          ("Inconnu", "Le manga des ados", True, True), ("Inconnu", "Essai", False, False))


LISTS = (("Rentrée littéraire 2025", "", True), ("Rentrée 2026", "", False), ("Prix 2024", "", False), ("Pépites 2023", "", True),
         ("Coups de coeur", "", False), ("", "/list-3/rentree-2024/", True))


@query("weeding_rule", """
with d as (select p_partkey, (p_partkey * 7) % 1000 as n from part)
select p_partkey, case when n < 100 then 5 when n between 340 and 349 then 3 when n between 320 and 329 then 5
   when n between 910 and 919 then 10 when n >= 700 then 15 else 10 end as age,
 case when n < 100 then 2 when n between 340 and 349 then 1 when n between 320 and 329 then 2
   when n between 910 and 919 then 3 when n >= 700 then 5 else 3 end as idle from d""")
def weeding_rule(t):
    dewey = F.concat(F.lpad(((F.col("p_partkey") * 7) % 1000).cast("string"), 3, "0"), F.lit(".5 ABC"))
    return t.part.select("p_partkey", R.weeding_rule(dewey).alias("r")).select("p_partkey", "r.age", "r.idle")


FILMS = (("", "x", "Nolan, C", "Adulte", "cote_absente"), ("914.4 ABC", "x", "N", "Adulte", ""), ("B NAP", "x", "N", "Adulte", ""),
         ("jv 12", "x", "N", "Adulte", ""), ("BDJ 741", "x", "N", "Adulte", "cote_non_conforme"),
         ("F NOL", "Warner", "Nolan, Christopher", "Jeunesse", "public_incoherent"), ("FJ DIS", "Disney", "Bird", "Jeunesse", ""),
         ("FJ BIR", "Disney", "Bird", "Adulte", "public_incoherent,disney_mal_cote"), ("FJ DIS", "Gaumont", "Bird", "Jeunesse", "fjdis_pas_disney"),
         ("F ABC", "x", None, "Adulte", "sans_realisateur"), ("F ABC", "x", "Nolan", "Adulte", "lettres_discordantes"),
         ("F LY", "x", "Ly, Ladj", "Adulte", ""))


@query("film_audit", f"""
with f as (select o_orderkey, unnest(string_split({sql_pick([c[4] for c in FILMS], 'o_orderkey')}, ',')) as anomaly from orders)
select o_orderkey, anomaly from f where anomaly <> ''""")
def film_audit(t):
    from shelfspark.operators.weeding import film_audit as audit_films
    cols = [pick([c[i] for c in FILMS], "o_orderkey").alias(n) for i, n in enumerate(("mark", "publisher", "people", "audience"))]
    return audit_films(t.orders.select("o_orderkey", *cols), "mark", "publisher", "people", "audience").select("o_orderkey", "anomaly")


@query("period_and_class", """
select p_partkey, case when 1990 + p_size >= 2023 then '2023-2026 (recent)' when 1990 + p_size >= 2020 then '2020-2022'
  when 1990 + p_size >= 2015 then '2015-2019' when 1990 + p_size >= 2010 then '2010-2014'
  when 1990 + p_size >= 2000 then '2000-2009' else 'avant 2000' end as period,
  substr(p_size::varchar, 1, 1) || '00' as class from part""")
def period_and_class(t):
    return t.part.select("p_partkey", R.period_bucket(F.col("p_size") + 1990).alias("period"),
                         R.dewey_class(F.col("p_size").cast("string")).alias("class"))


@query("source_priority", f"""
select l_orderkey, l_linenumber, l_partkey, case when l_returnflag = 'A' and l_linestatus = 'F' then 2
  when l_linestatus = 'F' then 2 + 3 else 0 + 3 end::int as rank from lineitem""")
def source_priority(t):
    source = F.when(F.col("l_linestatus") == "F", "c").otherwise("a")
    kind = F.when(F.col("l_returnflag") == "A", "manga").otherwise("bd")
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", source.alias("s"), kind.alias("k"))
    return df.select("l_orderkey", "l_linenumber", "l_partkey",
                     R.source_priority("k", "s", {"manga": ["c"]}, ["a", "b", "c"]).alias("rank"))


@query("corrections_worklist", f"""
with b as (select p_partkey, p_size, {sql_pick([c[0] for c in SERIES_CASES], 'p_partkey')} as s, {sql_pick([c[1] for c in SERIES_CASES], 'p_partkey')} as v,
   {sql_pick([c[2] for c in SERIES_CASES], 'p_partkey')} as verdict, p_name from part where p_size % 3 < 2),
 f as (select *, unnest(case when p_size % 3 = 0 then ['serie', 'genre'] else ['tome', 'serie'] end) as field from b)
select p_partkey, field, coalesce(case field when 'serie' then s when 'tome' then v else p_name end, '') as value,
  case when field = 'serie' and verdict <> 'series' then 'doubtful' else 'certain' end as list from f""")
def corrections_worklist(t):
    k = F.col("p_size") % 3
    df = t.part.select("p_partkey", "p_name", pick([c[0] for c in SERIES_CASES], "p_partkey").alias("s"),
                       pick([c[1] for c in SERIES_CASES], "p_partkey").alias("v"),
                       F.when(k == 0, "serie, genre").when(k == 1, "tome,serie").alias("marks"))
    return audit.corrections_worklist(df, "marks", {"serie": "s", "tome": "v", "genre": "p_name"}, "s", "v").select(
        "p_partkey", "field", "value", "list")
