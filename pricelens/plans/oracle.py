"""DuckDB SQL for the queries: an independent restatement over the same tables.

Only SQL text is built here; nothing is taken from the Spark side except fixed parameter values,
which are written out again. Queries without an entry are checked by property tests.
"""

# White space as a stripped text sees it.
_WS = "||".join(
    f"chr({c})"
    for c in [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
_CATEGORIES = (
    "['Appliances','Automotive','Cell_Phones_and_Accessories','Electronics','Musical_Instruments',"
    "'Office_Products','Tools_and_Home_Improvement','Toys_and_Games']"
)
_PROMPT_HEAD = "'What does this cost to the nearest dollar?'||chr(10)||chr(10)"
_PROMPT_TAIL = "chr(10)||chr(10)||'Price is $'"
_ESTIMATE = "'Estimate the price of this product. Respond with the price, no explanation'||chr(10)||chr(10)"
_CARD = (
    "'Create a concise description of a product. Respond only in this format. Do not include part numbers.'||chr(10)||"
    "'Title: Rewritten short precise title'||chr(10)||'Category: eg Electronics'||chr(10)||'Brand: Brand name'||chr(10)||"
    "'Description: 1 sentence description'||chr(10)||'Details: 1 sentence on features'"
)


def _strip(x):
    return f"trim({x}, {_WS})"


def _key(id_, seed):
    return f"('0x'||substr(md5({id_}::varchar||':{seed}'),1,13))::bigint"


def _u(id_, seed):
    return f"(({_key(id_, seed)}+0.5)/4503599627370496.0)"


def _quoted(x):
    body = f"replace(replace(replace(replace({x},'\\','\\\\'),chr(10),'\\n'),chr(13),'\\r'),chr(9),'\\t')"
    return (
        f"CASE WHEN contains({x},'''') AND NOT contains({x},'\"') THEN '\"'||{body}||'\"' "
        f"ELSE ''''||replace({body},'''','\\''')||'''' END"
    )


def _literal(xs):
    return f"'['||array_to_string(list_transform({xs}, lambda x: {_quoted('x')}), ', ')||']'"


def _simplify(xs):
    text = f"replace(replace(replace(replace({_literal(xs)},chr(10),' '),chr(13),''),chr(9),''),'  ',' ')"
    return f"substr({_strip(text)},1,3000)"


def _number(x):
    return f"CASE WHEN {x}='None' THEN NULL ELSE {x}::double END"


def _money(x):
    return f"'$'||printf('%.2f',round_even({x},2))"


def _dollars(x):
    return f"round_even({x},0)::bigint::varchar||'.00'"


def _codes(name, source, id_, text):
    """Code removal token by token: `source(id_, text)` becomes `name(id_, text)`."""
    rest = "array_to_string(toks[i:],'')"
    return f"""
{name}_l AS (SELECT {id_}, unnest(string_split({text},chr(10))) AS line, generate_subscripts(string_split({text},chr(10)),1) AS ln FROM {source}),
{name}_t AS (SELECT {id_}, ln, regexp_extract_all(line,'[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS toks FROM {name}_l),
{name}_c AS (SELECT {id_}, ln, array_to_string(list_transform(toks, lambda t, i: CASE WHEN regexp_full_match(t,'[A-Z0-9]{{7,}}')
  THEN CASE WHEN regexp_matches({rest},'[A-Z]') AND regexp_matches({rest},'[0-9]') THEN '' ELSE t END ELSE t END),'') AS line FROM {name}_t),
{name} AS (SELECT {id_}, string_agg(line, chr(10) ORDER BY ln) AS {text} FROM {name}_c GROUP BY {id_})"""


# ---- shared tables; each is one or more named CTEs

RAW = f"""
raw AS (SELECT d.doc_id AS id, split_part(d.text,chr(10),1) AS title, ({_CATEGORIES})[1+d.doc_id%8] AS category,
  CASE WHEN d.doc_id%97=13 THEN 'None' ELSE round_even(e.value*3,2)::varchar END AS price, [d.text] AS description,
  [split_part(d.text,chr(10),2),split_part(d.text,chr(10),3)] AS features,
  '{{"Item Weight": "'||p.p_size||' '||(['pounds','ounces','grams','kilograms','hundredths pounds','heavy'])[1+d.doc_id%6]
  ||'", "Part Number": "'||upper(substr(md5(d.doc_id::varchar),1,10))||'", "Brand": "'||p.p_brand||'"}}' AS details
  FROM documents d JOIN events e ON e.event_id=d.doc_id JOIN part p ON p.p_partkey=d.doc_id)"""

_WEIGHT_TEXT = "(details->>'$.\"Item Weight\"')"
_AMOUNT = f"split_part({_WEIGHT_TEXT},' ',1)::double"
_WEIGHT = f"""CASE split_part({_WEIGHT_TEXT},' ',2) WHEN 'pounds' THEN {_AMOUNT} WHEN 'ounces' THEN {_AMOUNT}/16
  WHEN 'grams' THEN {_AMOUNT}/453.592 WHEN 'kilograms' THEN {_AMOUNT}/0.453592 WHEN 'hundredths' THEN {_AMOUNT}/100 ELSE 0.0 END"""
_DETAILS_JSON = "'{\"Item Weight\": \"'||(details->>'$.\"Item Weight\"')||'\", \"Brand\": \"'||(details->>'$.Brand')||'\"}'"

SCRUBBED = f"""
joined AS (SELECT id, title||chr(10)||{_simplify('description')}||chr(10)||{_simplify('features')}||chr(10)||{_DETAILS_JSON}||chr(10) AS txt FROM raw),
{_codes('nocode', 'joined', 'id', 'txt')},
scrubbed AS (SELECT id, substr({_strip('txt')},1,4000) AS "full" FROM nocode)"""

ITEMS = f"""
items AS (SELECT * FROM (SELECT r.id, title, category, {_number('price')} AS price, "full", {_WEIGHT} AS weight
  FROM raw r JOIN scrubbed USING (id)) WHERE price BETWEEN 0.5 AND 999.49 AND length("full")>=600)"""


def _first_sentences(texts):
    """First sentences of the texts that aren't blank."""
    lines = f"list_filter(list_transform({texts}, lambda t: trim(regexp_replace(t,'[\\t-\\r ]+',' ','g'))), lambda t: t<>'')"
    return f"list_transform({lines}, lambda t: coalesce(nullif(regexp_extract(t,'^[^.!?]*[.!?]'),''),t))"


# Title, category, brand, one sentence about the product and one on its features; the weight is the one detail
# besides brand and part number.
CARDS = f"""
sentences AS (SELECT r.id, i.title, i.category, details->>'$.Brand' AS brand, 'Item Weight: '||(details->>'$."Item Weight"') AS other,
  {_first_sentences('description')} AS d, {_first_sentences('features')} AS f FROM raw r JOIN items i ON i.id=r.id),
cards AS (SELECT id, 'Title: '||coalesce(nullif(trim(title),''),'Unknown')||chr(10)||'Category: '||replace(category,'_',' ')||chr(10)
  ||'Brand: '||coalesce(nullif(trim(brand),''),'Unknown')||chr(10)||'Description: '||coalesce(d[1],f[1],'Unknown')||chr(10)
  ||'Details: '||coalesce(CASE WHEN len(d)>0 THEN f[1] ELSE f[2] END,other,'Unknown') AS summary FROM sentences),
{_codes('card', 'cards', 'id', 'summary')},
summ AS (SELECT i.*, c.summary FROM items i JOIN card c USING (id))"""


def _dedupe(source, name):
    k = _key("id", 42)
    return f"""
{name}_a AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY title ORDER BY {k}, id)=1),
{name} AS (SELECT * FROM {name}_a QUALIFY row_number() OVER (PARTITION BY "full" ORDER BY {k}, id)=1)"""


_FACTOR = "CASE category WHEN 'Tools_and_Home_Improvement' THEN 0.5::double WHEN 'Automotive' THEN 0.05::double ELSE 1.0::double END"
WEIGHTED = f"""
weighted AS (SELECT *, pow((price-min(price) OVER ())/(max(price) OVER ()-min(price) OVER ()+1e-9::double),2.0)*{_FACTOR} AS w FROM dd)"""
SAMPLE = f"""
sample AS (SELECT * FROM weighted WHERE w>0)"""
SPLITS = f"""
numbered AS (SELECT *, row_number() OVER (ORDER BY {_key('id', '42:split')}, id)-1 AS pos, count(*) OVER () AS n FROM sample),
sized AS (SELECT *, greatest(1, floor(100000.0::double*(n/1000000.0::double))::bigint) AS part FROM numbered),
splits AS (SELECT * EXCLUDE (pos, n, part),
  CASE WHEN pos<n-2*part THEN 'train' WHEN pos<n-part THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN pos<n-2*part THEN pos WHEN pos<n-part THEN pos-(n-2*part) ELSE pos-(n-part) END AS ord FROM sized)"""

_CLIP = "CASE WHEN length(title)>40 THEN substr(title,1,40)||'...' ELSE title END"
_PRICE_RX = "'[-+]?\\d*\\.\\d+|\\d+'"


def _extract(x):
    return f"coalesce(try_cast(nullif(regexp_extract(replace(replace({x},'$',''),',',''),{_PRICE_RX}),'') AS double),0.0)"


def _random(id_):
    return f"({_key(id_, '42:price')}%999+1)::double"


_BAND = """CASE WHEN error<40 OR (truth<>0 AND error/truth<0.2) THEN 'green'
  WHEN error<80 OR (truth<>0 AND error/truth<0.4) THEN 'orange' ELSE 'red' END"""
PREDICTIONS = f"""
guesses AS (SELECT ord, title, price, id, unnest([{{'model':'constant','guess':(SELECT avg(price) FROM splits WHERE split='train')}},
  {{'model':'random','guess':{_random('id')}}},
  {{'model':'text','guess':{_extract("'It costs about $'||round_even(price+12.5,2)::varchar||' or so'")}}}]) AS g FROM splits WHERE split='test'),
predictions AS (SELECT *, {_BAND} AS color FROM (SELECT g.model AS model, ord, {_CLIP} AS title, price AS truth, g.guess AS guess,
  abs(g.guess-price) AS error FROM guesses))"""

_R2 = "CASE WHEN var_pop(truth)=0 THEN CASE WHEN sum(error*error)=0 THEN 100.0 ELSE 0.0 END ELSE 100*(1-sum(error*error)/(count(*)*var_pop(truth))) END"
_METRICS = f"""count(*) AS n, avg(error) AS error, CASE WHEN count(*)>1 THEN 1.96*stddev_pop(error)/sqrt(count(*)) ELSE 0.0 END AS ci,
  avg(error*error) AS mse, {_R2} AS r2"""
METRICS = f"metrics AS (SELECT model, {_METRICS} FROM predictions GROUP BY model)"

POSITIONED = "positioned AS (SELECT *, row_number() OVER (ORDER BY id)-1 AS ord FROM items)"

_SHA = "substr(sha1(\"full\"),1,16)"


def _line(prefix):
    return f"to_json({{'key':{_SHA},'summary':'{prefix}'||title}})::varchar"


CHECKPOINT = f"""
known AS (SELECT id, {_SHA} AS key, title, category FROM items WHERE weight>0),
lines AS (SELECT id*2 AS ord, key, 'Draft: '||title AS summary FROM known WHERE category<>'Toys_and_Games'
  UNION ALL SELECT id*2+1, key, 'Card: '||title FROM known WHERE category='Electronics'),
done AS (SELECT key, max_by(summary,ord) AS summary FROM lines GROUP BY key)"""
OPEN = """
open_items AS (SELECT *, CASE WHEN weight>10 THEN 'Own: '||title WHEN price<5 THEN '' END AS summary FROM items)"""
ANSWERED = """
answered AS (SELECT *, CASE WHEN category<>'Appliances' THEN ' Card: '||title||chr(10) END AS summary FROM positioned)"""

INDEX = f"""
idx AS (SELECT e.vec_id AS id, e.embedding::double[] AS v, ({_CATEGORIES})[1+e.label%8] AS category, round_even(ev.value*3,2) AS price,
  coalesce(p.p_name,'vector '||e.vec_id) AS document FROM embeddings e JOIN events ev ON ev.event_id=e.vec_id
  LEFT JOIN part p ON p.p_partkey=e.vec_id)"""
KNN = """
pairs AS (SELECT q.id AS query_id, i.id, pow(list_distance(q.v,i.v),2) AS distance FROM idx q JOIN idx i ON i.id<>q.id),
knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance,9), id) AS rank FROM pairs QUALIFY rank<=5),
near AS (SELECT k.*, i.document, i.price FROM knn k JOIN idx i USING (id)),
knn_guess AS (SELECT query_id, sum(price/(distance+1e-9::double))/sum(1/(distance+1e-9::double)) AS guess FROM near GROUP BY query_id)"""


def _apart(a, b):
    """Squared distance of two lists of whole numbers, exact in doubles."""
    return f"(list_dot_product({a},{a})-2*list_dot_product({a},{b})+list_dot_product({b},{b}))"


def _listed():
    """Neighbours by an inverted file: 64 lists learned in three rounds on the 16,384 rows of the smallest hashes, four-bit residual codes."""
    key, rounds = _key("id", "lists"), ""
    for r in range(3):
        rounds += f"""
a{r} AS (SELECT id, min(struct_pack(d := {_apart('x', 'm')}, c := c)).c AS c FROM sx, c{r} GROUP BY id),
m{r} AS (SELECT c, list(e ORDER BY i) AS m FROM (SELECT c, i, floor(sum(x[i])/count(*)) AS e FROM a{r} JOIN sx USING (id), range(1,65) t(i) GROUP BY c, i) GROUP BY c),
c{r + 1} AS (SELECT c, coalesce(n.m, o.m) AS m FROM c{r} o LEFT JOIN m{r} n USING (c)),"""
    return f"""
sample AS (SELECT id FROM idx ORDER BY {key}, id LIMIT 16384),
unit AS (SELECT 2048/coalesce(nullif(max(list_max(list_transform(v, lambda e: abs(e)))),0),1) AS scale FROM idx JOIN sample USING (id)),
points AS (SELECT id, list_transform(v, lambda e: floor(e*scale+0.5)) AS x FROM idx, unit),
sx AS (SELECT * FROM points JOIN sample USING (id)),
c0 AS (SELECT row_number() OVER (ORDER BY {key}, id)-1 AS c, x AS m FROM sx QUALIFY c<64),{rounds}
own_list AS (SELECT id, any_value(x) AS x, min(struct_pack(d := {_apart('x', 'm')}, c := c)) AS best FROM points, c3 GROUP BY id),
cells AS (SELECT id, x, best.c AS c, c3.m FROM own_list JOIN c3 ON c3.c=best.c),
step AS (SELECT greatest(1, floor(sqrt(sum(pow(x[i]-m[i],2))/count(*))/2)) AS step FROM cells JOIN sample USING (id), range(1,65) t(i)),
decoded AS (SELECT id, list_transform(range(1,65), lambda i: m[i]+greatest(-8,least(7,floor((x[i]-m[i])/step)))*step+floor(step/2)) AS y FROM cells, step),
lengths AS (SELECT c3.c, c3.m, count(id) AS n FROM c3 LEFT JOIN cells ON cells.c=c3.c GROUP BY c3.c, c3.m),
reach AS (SELECT id, x, best, c, n, {_apart('x', 'm')} AS d FROM own_list, lengths),
probes AS (SELECT query_id, qx, c FROM (SELECT id AS query_id, x AS qx, c, n, d*100<=best.d*180 AS close,
  coalesce(sum(n) OVER (PARTITION BY id ORDER BY d, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS held FROM reach) WHERE n>0 AND (close OR held<32)),
scan AS (SELECT query_id, id FROM probes JOIN cells USING (c) JOIN decoded USING (id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_apart('qx', 'y')}, id)<=32),
seen AS (SELECT query_id, s.id, pow(list_distance(q.v,i.v),2) AS distance FROM scan s JOIN idx q ON q.id=query_id JOIN idx i ON i.id=s.id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(distance,9), s.id)<=6),
listed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance,9), id)::int AS rank FROM seen WHERE id<>query_id QUALIFY rank<=5)"""


LISTED = _listed()


def _unescape(x):
    for entity, char in (
        ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "''''"), ("&apos;", "''''"), ("&nbsp;", "chr(160)"),
        ("&copy;", "'©'"), ("&middot;", "'·'"), ("&amp;", "'&'"),
    ):
        x = f"replace({x},'{entity}',{char})"
    return x


_ARTICLE = "regexp_extract(html,'(?s)<article>(.*?)</article>',1)"
_SECTION = _unescape(f"regexp_replace({_ARTICLE},'<[^>]*>','','g')")
_TITLE = _unescape("regexp_extract(html,'(?s)<title>(.*?)</title>',1)")


def _deal_fields(title):
    return f"""substr({title},1,100) AS title,
  substr(CASE WHEN strpos(content,'Features')>0 THEN substr(content,1,strpos(content,'Features')-1) ELSE content END,1,500) AS details,
  CASE WHEN strpos(content,'Features')>0 THEN substr(content,strpos(content,'Features')+8,500) ELSE '' END AS features"""


PAGES = f"""
page_text AS (SELECT page_id, url, split_part(url,'/',3) AS feed, {_TITLE} AS title, {_SECTION} AS section FROM pages),
page_content AS (SELECT *, replace(replace(section,chr(10)||'more',''),chr(10),' ') AS content FROM page_text)"""
ENTRIES = """
entries AS (SELECT feed, title, CASE WHEN contains(url,'#') THEN NULL ELSE url END AS url,
  row_number() OVER (PARTITION BY feed ORDER BY page_id) AS rank FROM page_text QUALIFY rank<=10)"""
SCRAPED = f"""
scraped AS (SELECT e.feed, e.rank, e.url, {_deal_fields('e.title')} FROM entries e JOIN page_content c ON c.url=e.url)"""
_DEAL_TEXT = f"'Title: '||title||chr(10)||'Details: '||{_strip('details')}||chr(10)||'Features: '||{_strip('features')}||chr(10)||'URL: '||url"
_OFF = "'(?i)(\\$[\\d,]+(\\.\\d+)? off|(reduced|cut) by \\$[\\d,]+(\\.\\d+)?)'"
DEALS = f"""
deal_text AS (SELECT t.page_id AS pos, feed, url, ({_CATEGORIES})[1+t.page_id%8] AS category,
  section||' Now $'||e.value::varchar||' after $20 off' AS product_description FROM page_text t JOIN events e ON e.event_id=t.page_id),
deals AS (SELECT *, try_cast(nullif(replace(regexp_extract(regexp_replace(product_description,{_OFF},'','g'),'\\$([\\d,]+(?:\\.\\d+)?)',1),',',''),'') AS double) AS price FROM deal_text)"""
PRICED = """
means AS (SELECT category, round(avg(price),6) AS estimate FROM items GROUP BY category),
priced AS (SELECT d.*, m.estimate, m.estimate-d.price AS discount FROM deals d LEFT JOIN means m USING (category))"""
MEMORY = """
best AS (SELECT * FROM (SELECT * FROM priced QUALIFY row_number() OVER (PARTITION BY feed ORDER BY discount DESC NULLS LAST, pos)=1) WHERE discount>50)"""



def _poll(n):
    """Alert of poll `n`: the best of the five most detailed deals not alerted before."""
    seen = " ".join(f"AND url NOT IN (SELECT url FROM poll{i})" for i in range(n))
    return f"""
poll{n} AS (SELECT * FROM (SELECT * FROM (SELECT * FROM priced WHERE price>0 {seen} ORDER BY length(product_description) DESC, url LIMIT 5)
  ORDER BY discount DESC NULLS LAST, length(product_description) DESC, url LIMIT 1) WHERE discount>50)"""


ALERTS = ",".join([_poll(n) for n in range(3)]) + """,
alerts AS (SELECT 0::bigint AS batch_id, * FROM poll0 UNION ALL SELECT 1, * FROM poll1 UNION ALL SELECT 2, * FROM poll2)"""

# Least squares by successive residuals: each feature is cleared of the ones before it, so that the
# single slopes against the residuals give the joint fit.


def _letters(x):
    """Counts of the small letters of a text."""
    return f"list_transform(string_split('abcdefghijklmnopqrstuvwxyz',''), lambda c: (length({x})-length(replace({x},c,'')))::double)"


def _least_squares(target, p=""):
    """Least squares of `target` on weight, weight unknown and text length, one feature after the other; prefix `p` of its tables."""
    return f"""
{p}f0 AS (SELECT id, ord, price, split, {target} AS y, weight AS w, (weight=0)::int::double AS u, length(summary)::double AS l FROM splits WHERE split<>'validation'),
{p}c0 AS (SELECT avg(w) AS mw, avg(u) AS mu, avg(l) AS ml, avg(y) AS my FROM {p}f0 WHERE split='train'),
{p}f1 AS (SELECT f.*, w-mw AS r1, u-mu AS du, l-ml AS dl, y-my AS dy, my FROM {p}f0 f, {p}c0),
{p}c1 AS (SELECT regr_slope(du,r1) AS a, regr_slope(dl,r1) AS b, regr_slope(dy,r1) AS k1 FROM {p}f1 WHERE split='train'),
{p}f2 AS (SELECT f.*, du-a*r1 AS r2, dl-b*r1 AS el, k1 FROM {p}f1 f, {p}c1),
{p}c2 AS (SELECT regr_slope(el,r2) AS b2, regr_slope(dy,r2) AS k2 FROM {p}f2 WHERE split='train'),
{p}f3 AS (SELECT f.*, el-b2*r2 AS r3, k2 FROM {p}f2 f, {p}c2),
{p}c3 AS (SELECT regr_slope(dy,r3) AS k3 FROM {p}f3 WHERE split='train')"""


def _truncate(n):
    words = "list_filter(string_split_regex(summary,'\\s+'), lambda t: t<>'')"
    return f"CASE WHEN len({words})>{n} THEN rtrim(array_to_string(({words})[1:{n}],' ')) ELSE summary END"


_PROMPT_TITLE = f"split_part(split_part({_PROMPT_HEAD}||{_truncate(110)}||{_PROMPT_TAIL},'Title: ',2),chr(10),1)"
LINEAR = _least_squares("price")
# Prices of the five training texts with the most similar letters, and the log-price regression, blended.
BLENDED = [LINEAR, _least_squares("ln(price+1)", "l"), f"""
letters AS (SELECT id, ord, price, split, {_letters('summary')} AS v FROM splits WHERE split<>'validation'),
alike AS (SELECT t.id, i.price, pow(list_distance(t.v,i.v),2) AS distance FROM letters t JOIN letters i ON t.split='test' AND i.split='train'
  QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY round(pow(list_distance(t.v,i.v),2),9), i.id)<=5),
retrieved AS (SELECT id, sum(price/(round(distance,9)+1e-9::double))/sum(1/(round(distance,9)+1e-9::double)) AS guess FROM alike GROUP BY id),
fitted AS (SELECT f.id, my+k1*r1+k2*r2+k3*r3 AS linear, r.guess AS retrieval,
  (SELECT greatest(0.0,exp(l.my+l.k1*l.r1+l.k2*l.r2+lc3.k3*l.r3)-1) FROM lf3 l, lc3 WHERE l.id=f.id) AS log_features
  FROM f3 f JOIN retrieved r ON r.id=f.id, c3 WHERE f.split='test'),
blended AS (SELECT *, 0.8::double/0.9*greatest(0.5,least(999.49,retrieval))+0.1::double/0.9*greatest(0.5,least(999.49,log_features)) AS ensemble FROM fitted)"""]

_ITEMS = [RAW, SCRUBBED, ITEMS]
_SUMM = [*_ITEMS, CARDS]
_DEDUP = [*_SUMM, _dedupe("summ", "dd")]
_SPLITS = [*_DEDUP, WEIGHTED, SAMPLE, SPLITS]
_PRED = [*_SPLITS, PREDICTIONS]
_DEALS = [PAGES, DEALS]
_PRICED = [*_ITEMS, *_DEALS, PRICED]


def _sql(tables, select):
    return ("WITH " + ",".join(tables) + "\n" + select) if tables else select


_ROW = 'title, category, price, "full", round(weight,6) AS weight'
_TEXT = f"SELECT id, array_to_string(list_filter(string_split_regex(summary,'\\s+'), lambda t: t<>''),' ') AS t FROM splits"


def _completion():
    return f"CASE WHEN split='test' THEN price::varchar ELSE {_dollars('price')} END"


def _words(x):
    return f"len(list_filter(string_split_regex({x},'\\s+'), lambda t: t<>''))::int"


_FULL_PROMPT = f"{_PROMPT_HEAD}||summary||{_PROMPT_TAIL}"
_NAMES = "CASE model WHEN 'text' THEN 'frontier' WHEN 'constant' THEN 'specialist' ELSE 'neural_network' END"


def _blend(**weights):
    case = " ".join(f"WHEN '{m}' THEN {w}::double" for m, w in weights.items())
    names = ",".join(f"'{m}'" for m in weights)
    return f"""SELECT ord, round(sum((CASE m {case} END)*greatest(0.5,least(999.49,guess))),6) AS guess
FROM (SELECT *, {_NAMES} AS m FROM predictions) WHERE m IN ({names}) GROUP BY ord"""


_DEAL_PREFIX = (
    "'Respond with the most promising 5 deals from this list, selecting those which have the most detailed, high quality product "
    "description and a clear price that is greater than 0.'||chr(10)||"
    "'You should rephrase the description to be a summary of the product itself, not the terms of the deal.'||chr(10)||"
    "'Remember to respond with a short paragraph of text in the product_description field for each of the 5 items that you select.'||chr(10)||"
    "'Be careful with products that are described as \"$XXX off\" or \"reduced by $XXX\" - this isn''t the actual price of the product. "
    "Only respond with products when you are highly confident about the price.'||chr(10)||chr(10)||'Deals:'||chr(10)||chr(10)"
)
_FLAT_MEMORY = "SELECT product_description, price, url, round(estimate,6) AS estimate, round(discount,6) AS discount FROM best"
# Stop words that can occur as a token of two or more letters.
_STOP = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being "
    "have has had having do does did doing an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once "
    "here there when where why how all any both each few more most other some such no nor not only own same so than too very "
    "can will just don should now cannot could ought would"
)
_STOP_SQL = ",".join(f"'{w}'" for w in _STOP.split())
_MONEY3 = f"{_money('price')} AS price, {_money('estimate')} AS estimate, {_money('discount')} AS discount"
_COLORS = "(['red','blue','brown','orange','yellow','green','purple','cyan'])"
_PIECES = (
    f"array_to_string(list_filter(list_transform(string_split_regex({_ARTICLE},'<[^>]*>'), lambda p: {_strip(_unescape('p'))}), lambda p: p<>''),' ')"
)

ORACLES = {
    "read_products": _sql(_ITEMS, f"SELECT {_ROW} FROM items"),
    "load_categories": _sql(
        _ITEMS, f"SELECT {_ROW} FROM items WHERE category NOT IN ('Tools_and_Home_Improvement','Automotive')"
    ),
    "category_cache": _sql(_ITEMS, f"SELECT {_ROW} FROM items"),
    "save_splits": _sql(_SPLITS, f"SELECT split, ord, {_PROMPT_HEAD}||{_truncate(110)}||{_PROMPT_TAIL} AS prompt, {_completion()} AS completion FROM splits"),
    "load_splits": _sql(_SPLITS, f"SELECT split, ord, id, {_ROW}, summary FROM splits"),
    "chat_jsonl": _sql(_SPLITS, f"SELECT split, {_ESTIMATE}||summary AS \"user\", {_money('price')} AS assistant FROM splits"),
    "batch_requests": _sql([*_ITEMS, POSITIONED], """SELECT (ord//100*100)||'_'||least((ord//100+1)*100, count(*) OVER ())||'.jsonl' AS file,
  ord::varchar AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, 'openai/gpt-oss-20b' AS model, "full" AS content,
  'low' AS reasoning_effort FROM positioned"""),
    "batch_results": _sql([*_ITEMS, POSITIONED, ANSWERED], "SELECT ord, summary AS content FROM answered WHERE summary IS NOT NULL"),
    "checkpoint_read": _sql([*_ITEMS, CHECKPOINT], "SELECT key, summary FROM done"),
    "guesses_csv": _sql(_SPLITS, "SELECT summary, 0.0::double AS guess FROM splits WHERE split='test' AND ord<100"),
    "memory_table": _sql([*_PRICED, MEMORY], _FLAT_MEMORY),
    "deal_source": _sql([PAGES, ENTRIES, SCRAPED], "SELECT * FROM scraped"),
    "index_store": _sql([INDEX], "SELECT 'doc_'||id AS doc, document, category, price, round(list_sum(v),4) AS total FROM idx"),
    "index_resume": _sql([INDEX], "SELECT 'doc_'||id AS doc, document, category, price FROM idx"),
    "price_filter": _sql([RAW], f"SELECT * FROM (SELECT id, {_number('price')} AS price FROM raw) WHERE price BETWEEN 0.5 AND 999.49"),
    "simplify_text": _sql([RAW], f"SELECT id, {_simplify('description')} AS text FROM raw"),
    "list_literal": _sql([RAW], f"SELECT id, {_literal('list_concat(features,description)')} AS text FROM raw"),
    "details_map": _sql([RAW], f"""SELECT id, 'Brand='||(details->>'$.Brand')||';Item Weight='||{_WEIGHT_TEXT}||';Part Number='||(details->>'$."Part Number"') AS entries FROM raw"""),
    "drop_noise_keys": _sql([RAW], f"SELECT id, 'Brand='||(details->>'$.Brand')||';Item Weight='||{_WEIGHT_TEXT} AS entries FROM raw"),
    "details_json": _sql([RAW], f"SELECT id, {_DETAILS_JSON} AS json FROM raw"),
    "strip_codes": _sql(["src AS (SELECT doc_id AS id, text FROM documents)", _codes("nocode", "src", "id", "text")], "SELECT id, text FROM nocode"),
    "scrub_text": _sql([RAW, SCRUBBED], 'SELECT id, "full" FROM scrubbed'),
    "weight_pounds": _sql([RAW], f"SELECT id, round({_WEIGHT},6) AS weight FROM raw"),
    "min_text_filter": _sql([RAW, SCRUBBED], 'SELECT id, length("full")::int AS n_chars FROM scrubbed WHERE length("full")>=600'),
    "parse_items": _sql(_ITEMS, f"SELECT id, {_ROW} FROM items"),
    "inference_prompt": _sql(_SUMM, f"SELECT id, {_FULL_PROMPT} AS prompt FROM summ"),
    "extract_price": _sql([RAW], f"""SELECT id, {_extract('description[1]')} AS from_text,
  CASE WHEN price='None' THEN 0.0 ELSE {_extract("format('{:,.2f}', round_even(price::double*10,2))")} END AS from_answer FROM (SELECT id, description,
  price FROM raw)""".replace("price::double", "(CASE WHEN price='None' THEN '0' ELSE price END)::double")),
    "make_prompt": _sql(_SUMM, f"SELECT id, {_FULL_PROMPT}||{_dollars('price')} AS prompt FROM summ"),
    "test_prompt": _sql(_SUMM, f"SELECT id, split_part({_FULL_PROMPT},'Price is $',1)||'Price is $' AS prompt FROM summ"),
    "token_count": _sql(_SPLITS, f"""SELECT id, {_words('summary')} AS summary_tokens,
  {_words(f"{_PROMPT_HEAD}||{_truncate(110)}||{_PROMPT_TAIL}||{_completion()}")} AS pair_tokens FROM splits"""),
    "prompt_pairs": _sql(_SPLITS, f"SELECT split, ord, {_PROMPT_HEAD}||{_truncate(30)}||{_PROMPT_TAIL} AS prompt, {_completion()} AS completion FROM splits"),
    "datapoint": _sql(_SPLITS, f"SELECT {_PROMPT_HEAD}||{_truncate(110)}||{_PROMPT_TAIL} AS prompt, {_completion()} AS completion FROM splits"),
    "content_key": _sql(_ITEMS, f"SELECT id, {_SHA} AS key FROM items"),
    "summary_messages": _sql(_ITEMS, f"SELECT id, {_CARD} AS system, \"full\" AS \"user\" FROM items"),
    "summary_card": _sql(_SUMM, "SELECT id, summary FROM summ"),
    "price_messages": _sql(_SUMM, f"SELECT id, {_ESTIMATE}||summary AS \"user\" FROM summ"),
    "rag_context": _sql([INDEX, KNN], f"""SELECT q.id AS query_id, {_ESTIMATE}||any_value(q.document)||chr(10)||chr(10)||
  'To provide some context, here are some other items that might be similar to the item you need to estimate.'||chr(10)||chr(10)||
  string_agg('Potentially related product:'||chr(10)||n.document||chr(10)||'Price is '||{_money('n.price')}||chr(10)||chr(10),'' ORDER BY n.rank) AS content
  FROM near n JOIN idx q ON q.id=n.query_id GROUP BY q.id"""),
    "price_features": _sql(_SUMM, "SELECT id, round(weight,6) AS weight, (weight=0)::int AS weight_unknown, length(summary)::int AS text_length FROM summ"),
    "truth_title": _sql(_SPLITS, f"""SELECT id, CASE WHEN split='test' THEN price ELSE round_even(price,0) END AS truth, {_CLIP} AS item_title,
  CASE WHEN length(line)>40 THEN substr(line,1,40)||'...' ELSE line END AS prompt_title
  FROM (SELECT *, split_part(split_part({_truncate(110)},'Title: ',2),chr(10),1) AS line FROM splits)"""),
    "error_band": _sql(_PRED, "SELECT model, ord, round(error,6) AS error, color FROM predictions"),
    "metrics_report": _sql([*_PRED, METRICS], """SELECT model||'__4o_gpt' AS model, upper(substr(model,1,1))||substr(model,2)||'.4O GPT' AS title,
  upper(substr(model,1,1))||substr(model,2)||'.4O GPT: error=$'||format('{:,.2f}',round_even(error,2))||' ±$'||format('{:,.2f}',round_even(ci,2))
  ||' mse='||format('{:,.0f}',round_even(mse,0))||' r²='||printf('%.1f',round_even(r2,1))||'%' AS report FROM metrics"""),
    "clean_html": f"""SELECT page_id, replace({_strip(f"regexp_replace({_PIECES},'<[^<]+?>','','g')")},chr(10),' ') AS article,
  replace(html,chr(10),' ') AS snippet FROM pages""",
    "page_section": _sql([PAGES], "SELECT page_id, section FROM page_text"),
    "deal_fields": _sql([PAGES], f"SELECT page_id, {_deal_fields('title')} FROM page_content"),
    "deal_text": _sql([PAGES, ENTRIES, SCRAPED], f"SELECT feed, rank, {_DEAL_TEXT} AS text FROM scraped"),
    "deal_digest": _sql([PAGES, ENTRIES, SCRAPED], f"""SELECT feed, {_DEAL_PREFIX}||string_agg({_DEAL_TEXT},chr(10)||chr(10) ORDER BY rank)
  ||chr(10)||chr(10)||'Include exactly 5 deals, no more.' AS prompt, count(*) AS deals FROM scraped GROUP BY feed"""),
    "discount": _sql(_PRICED, "SELECT url, price, round(estimate,6) AS estimate, round(discount,6) AS discount FROM priced"),
    "positive_price": _sql(_DEALS, "SELECT url, price, product_description FROM deals WHERE price>0"),
    "alert_text": _sql(_PRICED, f"""SELECT pos, 'Deal Alert! Price='||{_money('price')}||', Estimate='||{_money('estimate')}||', Discount='||{_money('discount')}
  ||' :'||substr(product_description,1,10)||'... '||url AS alert, substr(product_description,1,200)||'... '||url AS notice FROM priced"""),
    "deal_report": _sql(_PRICED, f"SELECT product_description, {_MONEY3}, url FROM priced"),
    "clear_columns": _sql(_SPLITS, 'SELECT split, ord, title, price, summary, NULL::varchar AS "full", NULL::bigint AS id FROM splits'),
    "clamp_price": _sql([RAW], f"SELECT id, round(greatest(0.5,least(999.49,coalesce(({_number('price')})*3-20,0.0))),6) AS price FROM raw"),
    "nonneg": _sql(_PRED, "SELECT model, ord, round(greatest(0.0,guess-100),6) AS guess FROM predictions"),
    "checkpoint_join": _sql([*_ITEMS, CHECKPOINT, OPEN], f"SELECT o.id, coalesce(nullif(o.summary,''),d.summary) AS summary FROM open_items o LEFT JOIN done d ON d.key={_SHA}"),
    "pending_anti": _sql([*_ITEMS, CHECKPOINT, OPEN], f"SELECT id, title FROM open_items WHERE nullif(summary,'') IS NULL AND {_SHA} NOT IN (SELECT key FROM done)"),
    "batch_join": _sql([*_ITEMS, POSITIONED, ANSWERED], "SELECT id, ord, summary FROM answered"),
    "seen_anti": _sql([*_PRICED, MEMORY], "SELECT url, price FROM deals WHERE url NOT IN (SELECT url FROM best)"),
    "guess_lookup": _sql(_SPLITS, """SELECT id, t.summary, g.guess FROM splits t LEFT JOIN (SELECT summary, max(guess) AS guess FROM (
  SELECT summary, (length(summary)+CASE WHEN category='Electronics' THEN 1000 ELSE 0 END)::double AS guess FROM splits
  WHERE split='test' AND category<>'Appliances') GROUP BY summary) g ON g.summary=t.summary WHERE t.split='test'"""),
    "knn_join": _sql([INDEX, KNN], "SELECT query_id, rank, id, round(distance,6) AS distance, price FROM near"),
    "weights_join": _sql(_PRED, _blend(frontier=0.8, specialist=0.1, neural_network=0.1)),
    "ensemble_price": _sql(_PRED, _blend(frontier="(0.8::double/0.9)", neural_network="(0.1::double/0.9)")),
    "split_leakage": _sql(_SPLITS, """SELECT count(*) AS leaks FROM splits t JOIN splits r ON r.split='train' AND (r.title=t.title OR r."full"=t."full") WHERE t.split='test'"""),
    "mean_price": _sql(_SPLITS, "SELECT round(avg(price),6) AS mean_price FROM splits WHERE split='train'"),
    "price_range": _sql(_ITEMS, "SELECT min(price) AS lo, max(price) AS hi FROM items"),
    "log_target_stats": _sql(_SPLITS, "SELECT round(avg(ln(price+1)),6) AS y_mean, round(stddev_samp(ln(price+1)),6) AS y_std FROM splits WHERE split='train'"),
    "eval_metrics": _sql([*_PRED, METRICS], "SELECT model, n, round(error,4) AS error, round(ci,4) AS ci, round(mse,4) AS mse, round(r2,4) AS r2 FROM metrics"),
    "truncation_rate": _sql(_SPLITS, f"SELECT round(avg(({_words('summary')}>40)::int),6) AS rate, count(*) AS n FROM splits"),
    "category_counts": _sql(_DEDUP, """SELECT s.category, count(*) AS kept, (SELECT count(*) FROM dd WHERE dd.category=s.category) AS unique_items
  FROM summ s GROUP BY s.category"""),
    "summary_progress": _sql([*_ITEMS, POSITIONED, ANSWERED], """SELECT *, CASE WHEN batch_id IS NULL THEN 'submit' WHEN NOT done THEN 'fetch' ELSE 'done' END AS state
  FROM (SELECT ord//100 AS batch, min(ord) AS start, max(ord)+1 AS "end", count(*) AS requested, count(summary) AS answered,
  count(summary)=count(*) AS done, CASE WHEN ord//100<(SELECT max(ord)//100 FROM answered) THEN 'batch_'||(ord//100) END AS batch_id
  FROM answered GROUP BY ord//100)"""),
    "usage_totals": _sql([*_ITEMS, OPEN], f"""SELECT 'primary' AS model, count(*) AS calls, sum(i)::bigint AS input_tokens, sum(o)::bigint AS output_tokens, 0.0::double AS cost FROM (
  SELECT DISTINCT "full", {_words('"full"')} AS i, {_words("'Card: '||split_part(\"full\",chr(10),1)")} AS o FROM open_items WHERE nullif(summary,'') IS NULL)"""),
    "usage_progress": _sql([*_ITEMS, OPEN], f"""SELECT count(*) AS calls, sum(i)::bigint AS input_tokens, sum(o)::bigint AS output_tokens, 0.0::double AS cost FROM (
  SELECT DISTINCT "full", {_words('"full"')} AS i, {_words("'Card: '||split_part(\"full\",chr(10),1)")} AS o FROM open_items WHERE nullif(summary,'') IS NULL)"""),
    "best_deal": _sql([*_PRICED, MEMORY], "SELECT feed, url, price, round(estimate,6) AS estimate, round(discount,6) AS discount FROM best"),
    "leaderboard": _sql(_PRED, """, m AS (SELECT 'all' AS test_set, model, avg(error) AS error FROM predictions GROUP BY model
  UNION ALL SELECT 'first', model, avg(error) FROM predictions WHERE ord<50 GROUP BY model)
  SELECT test_set, model, round(error,4) AS error, rank() OVER (PARTITION BY test_set ORDER BY error)::int AS rank,
  round_even((1-error/max(CASE WHEN model='constant' THEN error END) OVER (PARTITION BY test_set))*100,0) AS percent_lower,
  count(*) OVER (PARTITION BY test_set) AS models FROM m"""),
    "band_counts": _sql(_PRED, "SELECT model, color, count(*) AS n FROM predictions GROUP BY model, color"),
    "ordinal": _sql([*_ITEMS, POSITIONED], "SELECT id, ord FROM positioned"),
    "running_error": _sql(_PRED, """SELECT model, ord, round(m,4) AS mean_error, CASE WHEN ord=0 THEN 0.0 ELSE round(1.96*sqrt(greatest(q-m*m,0))/sqrt(ord+1),4) END AS ci
  FROM (SELECT model, ord, avg(error) OVER w AS m, avg(error*error) OVER w AS q FROM predictions
  WINDOW w AS (PARTITION BY model ORDER BY ord ROWS UNBOUNDED PRECEDING))"""),
    "first_per_key": _sql(_ITEMS, f"SELECT id, title FROM items QUALIFY row_number() OVER (PARTITION BY title ORDER BY {_key('id', 42)}, id)=1"),
    "top_n_per_feed": _sql([PAGES, ENTRIES], "SELECT feed, rank, title, url FROM entries"),
    "sample_per_category": _sql(_ITEMS, f"SELECT id, category, price FROM items QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_key('id', '42:category')}, id)<=50"),
    "shuffle": _sql(_ITEMS, f"SELECT id, row_number() OVER (ORDER BY {_key('id', 42)}, id)-1 AS ord FROM items"),
    "dedupe": _sql([*_ITEMS, _dedupe("items", "dd")], 'SELECT id, title, "full" FROM dd'),
    "sample_weights": _sql([*_DEDUP, WEIGHTED], "SELECT id, round(w/sum(w) OVER (),9) AS w FROM weighted"),
    "weighted_sample": _sql([*_DEDUP, WEIGHTED], f"SELECT id, category, price FROM weighted WHERE w>0 ORDER BY -ln({_u('id', '42:sample')})/w, id LIMIT 400"),
    "split": _sql(_SPLITS, "SELECT id, split, ord FROM splits"),
    "lite_subset": _sql(_SPLITS, "SELECT id, split, ord FROM splits WHERE ord<CASE split WHEN 'train' THEN 400 ELSE 30 END"),
    "head_clip": _sql(_SPLITS, "SELECT id, ord, price FROM splits WHERE split='train' AND ord<200"),
    "holdout_1pct": _sql(_SPLITS, f"""SELECT id, row_number() OVER (ORDER BY {_key('id', '42:holdout')}, id)-1<ceil(count(*) OVER ()*0.01::double) AS holdout
  FROM splits WHERE split='train'"""),
    "top_deals": _sql(_DEALS, "SELECT url, price, product_description FROM deals WHERE price>0 ORDER BY length(product_description) DESC, url LIMIT 5"),
    "trim_memory": _sql([*_PRICED, MEMORY], _FLAT_MEMORY + " ORDER BY url LIMIT 2"),
    "flatten_resplit": _sql(_SPLITS, f"SELECT split, ord, id, length({_truncate(20)})::int AS n_chars FROM splits"),
    "union_categories": _sql(_ITEMS, "SELECT category, count(*) AS n, round(sum(price),2) AS total FROM items GROUP BY category"),
    "index_sample": _sql([INDEX], f"SELECT id, document, category, {_COLORS}[list_position({_CATEGORIES},category)] AS color FROM idx ORDER BY id LIMIT 2000"),
    "random_price": _sql(_ITEMS, f"SELECT id, {_random('id')} AS guess FROM items"),
    "constant_price": _sql(_SPLITS, "SELECT id, price, round((SELECT avg(price) FROM splits WHERE split='train'),6) AS guess FROM splits WHERE split='test'"),
    "linear_price": _sql([*_SPLITS, LINEAR], "SELECT id, ord, price, round(my+k1*r1+k2*r2+k3*r3,4) AS guess FROM f3, c3 WHERE split='test'"),
    "model_store": _sql(_SPLITS, "SELECT ord, true AS same FROM splits WHERE split='test'"),
    "stream_deals": _sql([*_PRICED, ALERTS], "SELECT batch_id, url, price, round(estimate,6) AS estimate, round(discount,6) AS discount FROM alerts"),
    "stream_seen_state": _sql([*_PRICED, ALERTS], "SELECT url, price FROM deals WHERE url NOT IN (SELECT url FROM alerts)"),
    "stream_best_per_poll": _sql([*_PRICED, ALERTS], "SELECT batch_id, 1::bigint AS alerts, round(discount,6) AS discount FROM alerts"),
    "stream_scrape": _sql([PAGES], f"""SELECT poll, feed, pos, url, {_deal_fields('title')} FROM (
  SELECT *, poll, row_number() OVER (PARTITION BY poll, feed ORDER BY CASE poll WHEN 0 THEN page_id ELSE -page_id END)-1 AS pos FROM page_content, range(2) r(poll))
  WHERE pos<10 AND NOT contains(url,'#')"""),
    "bag_of_words": _sql(_SPLITS, f"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(summary),'[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM splits WHERE split='train')
  WHERE term NOT IN ({_STOP_SQL}) GROUP BY term ORDER BY n DESC, term LIMIT 2000"""),
    "log_target": _sql(_SPLITS, """SELECT id, round((ln(price+1)-m)/s,6) AS z, round(greatest(0.0,exp((ln(price+1)-m)/s*s+m)-1),6) AS price_again
  FROM splits, (SELECT avg(ln(price+1)) AS m, stddev_samp(ln(price+1)) AS s FROM splits WHERE split='train') WHERE split='train'"""),
    "knn_price": _sql([INDEX, KNN], "SELECT g.query_id, i.price, round(g.guess,4) AS guess FROM knn_guess g JOIN idx i ON i.id=g.query_id"),
    "ensemble_predict": _sql([*_SPLITS, *BLENDED], "SELECT id, round(retrieval,4) AS retrieval, round(log_features,4) AS log_features, round(ensemble,4) AS guess FROM blended"),
    "predict_table": _sql(_PRED, "SELECT model, ord, title, truth, round(guess,6) AS guess, round(error,6) AS error, color FROM predictions"),
    "knn_lsh": _sql([INDEX, LISTED], "SELECT query_id, rank, id, round(distance,6) AS distance FROM listed"),
    "knn_recall": _sql([INDEX, KNN, LISTED], """SELECT (SELECT count(*) FROM idx) AS queries, round(count(l.id)/count(*)::double,4) AS recall,
  (SELECT round(count(*)/(SELECT count(*)**2 FROM idx),4) FROM probes JOIN cells USING (c)) AS scanned,
  round(least(32,(SELECT count(*) FROM idx))/(SELECT count(*) FROM idx)::double,4) AS reranked
  FROM knn k LEFT JOIN listed l ON l.query_id=k.query_id AND l.id=k.id"""),
    "index_search": f"""WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL),
early AS (SELECT text, row_number() OVER (ORDER BY min(doc_id))-1 AS id FROM d WHERE lang='en' GROUP BY text),
late AS (SELECT text, (SELECT count(*) FROM early)+row_number() OVER (ORDER BY max(doc_id) DESC)-1 AS id FROM d WHERE text NOT IN (SELECT text FROM early) GROUP BY text),
meta AS (SELECT text, arg_max(lang,doc_id) AS lang, upper(arg_max(source,doc_id)) AS source FROM d GROUP BY text),
stored AS (SELECT id, lang, source, {_letters('text')} AS v FROM (FROM early UNION ALL FROM late) JOIN meta USING (text)),
asked AS (SELECT doc_id AS query_id, {_letters('split_part(text,chr(10),1)')} AS v FROM d),
far AS (SELECT query_id, id, lang, source, pow(list_distance(asked.v,stored.v),2) AS distance FROM asked, stored)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(distance,9), id)::int AS rank, 'doc_'||id AS doc, lang, source, round(distance,6) AS distance
FROM far QUALIFY rank<=5""",
    "evaluate": _sql([*_PRED, *BLENDED, f"""
human AS (SELECT summary, length(summary)::double AS guess FROM splits WHERE split='test' AND category<>'Appliances' GROUP BY summary),
fits AS (SELECT id, unnest([{{'model':'linear','guess':linear}},{{'model':'retrieval','guess':retrieval}},{{'model':'log_features','guess':log_features}},
  {{'model':'ensemble','guess':ensemble}}]) AS g FROM blended),
more AS (SELECT g.model, id, g.guess FROM fits UNION ALL SELECT 'human', id, human.guess FROM splits s LEFT JOIN human ON human.summary=s.summary WHERE split='test'),
scored AS (SELECT model, ord, title, truth, guess, error, color FROM predictions UNION ALL SELECT *, {_BAND} AS color FROM
  (SELECT model, ord, {_CLIP} AS title, price AS truth, guess, abs(guess-price) AS error FROM more JOIN splits USING (id))),
metrics AS (SELECT model, count(*) AS n, avg(error) AS error, CASE WHEN count(*)>1 THEN 1.96*stddev_pop(error)/sqrt(count(*)) ELSE 0.0 END AS ci,
  avg(error*error) AS mse, {_R2} AS r2 FROM scored GROUP BY model)"""], """SELECT m.model, n, round(m.error,4) AS error, round(ci,4) AS ci, round(mse,4) AS mse, round(r2,4) AS r2,
  count(*) FILTER (guess IS NULL) AS missing, count(*) FILTER (color='green') AS green, count(*) FILTER (color='orange') AS orange, count(*) FILTER (color='red') AS red
  FROM metrics m JOIN scored p ON p.model=m.model GROUP BY ALL"""),
    "evaluate_prompts": _sql([*_SPLITS, f"""
asked AS (SELECT s.ord, CASE WHEN length({_PROMPT_TITLE})>40 THEN substr({_PROMPT_TITLE},1,40)||'...' ELSE {_PROMPT_TITLE} END AS title, price AS truth,
  unnest([{{'model':'constant','guess':(SELECT avg(price) FROM splits WHERE split='train')}},{{'model':'prompt_length','guess':length({_truncate(110)})/10.0::double}}]) AS g
  FROM splits s WHERE split='test'),
scored AS (SELECT *, {_BAND} AS color FROM (SELECT g.model, ord, title, truth, g.guess, abs(g.guess-truth) AS error FROM asked))"""],
        "SELECT model, ord, title, truth, round(guess,6) AS guess, round(error,6) AS error, color FROM scored"),
    "map_with_checkpoint": _sql([*_ITEMS, OPEN], "SELECT id, coalesce(nullif(summary,''),'Card: '||split_part(\"full\",chr(10),1)) AS summary FROM open_items"),
    "encode_hook": _sql(_SUMM, f"SELECT id, length(summary)::double AS chars, {_words('summary')}::double AS words, len(string_split(summary,chr(10)))::double AS lines FROM summ"),
    "predictor_hook": _sql(_SPLITS, f"""SELECT 'custom' AS model, ord, {_CLIP} AS title, price AS truth, guess, round(abs(guess-price),6) AS error, color FROM (
  SELECT *, price AS truth, {_BAND} AS color FROM (SELECT *, price AS truth0, CASE WHEN weight=0 THEN 0.0 ELSE length(summary)::double END AS guess,
  abs(CASE WHEN weight=0 THEN 0.0 ELSE length(summary)::double END-price) AS error FROM splits WHERE split='test'))"""),
    "curate_evaluate": _sql([*_PRED, METRICS], "SELECT model, n, round(error,4) AS error, round(ci,4) AS ci, round(mse,4) AS mse, round(r2,4) AS r2 FROM metrics"),
}
