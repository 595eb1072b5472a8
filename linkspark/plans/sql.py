"""The text functions as DuckDB expressions, for the side-by-side check. Its regular expressions have no lookaround."""

from __future__ import annotations

from linkspark.functions import text as tx


def case(words: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in words.items()) + f" ELSE {x} END"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def words(x: str, pattern: str = r"\s+") -> str:
    return f"list_filter(string_split_regex({x}, '{pattern}'), lambda w_: w_ <> '')"


def name_tokens(folded: str) -> str:
    domain = tx.DOMAIN
    own = f"CASE WHEN regexp_matches(r_, '{domain}') THEN regexp_extract(r_, '{domain}', 1) ELSE r_ END"
    parts = words("replace(" + folded + ", '&', ' and ')")
    return f"list_transform(flatten(list_transform({parts}, lambda r_: {words(own, '[^0-9a-z]+')})), lambda t_: {case(tx.LEGAL_FORMS, 't_')})"


def normalize_name(x: str) -> str:
    return f"coalesce(array_to_string({name_tokens(fold(x))}, ' '), '')"


def in_list(x: str, own: list[str]) -> str:
    return f"{x} IN ({', '.join(repr(w) for w in own)})"


def core_name(x: str) -> str:
    return f"coalesce(array_to_string(list_filter({name_tokens(fold(x))}, lambda c_: NOT {in_list('c_', tx.LEGAL_WORDS)}), ' '), '')"


def normalize_address(x: str) -> str:
    tokens = words(fold(x), "[^0-9a-z]+")
    kept = f"list_transform([{tokens}], lambda a_: list_transform(list_filter(range(1, len(a_) + 1), lambda i_: NOT ({in_list('a_[i_]', tx.NUMBER_MARKERS)} AND coalesce(regexp_full_match(a_[i_ + 1], '[0-9]+'), false))), lambda i_: a_[i_]))[1]"
    clean = "CASE WHEN regexp_full_match(k_, '[0-9]+') THEN regexp_replace(k_, '^0+(.)', '\\1') ELSE k_ END"
    return f"coalesce(array_to_string(list_transform({kept}, lambda k_: {case(tx.ADDRESS_WORDS, '(' + clean + ')')}), ' '), '')"


def skeleton_token(t: str) -> str:
    out = t
    for a, b in tx.SOUNDS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"replace(regexp_replace({out}, 'c([eiy])', 's\\1', 'g'), 'c', 'k')"
    bare = "(CASE WHEN regexp_matches(s_, '^[aeiouy]') THEN 'a' ELSE '' END || regexp_replace(s_, '[aeiouyh]', '', 'g'))"
    for c in "abdfgjklmnprstv0123456789":
        bare = f"regexp_replace({bare}, '{c}{c}+', '{c}', 'g')"
    reduced = f"list_transform([{out}], lambda s_: list_transform([{bare}], lambda b_: CASE WHEN b_ = '' THEN substr(s_, 1, 1) ELSE b_ END)[1])[1]"
    return f"CASE WHEN regexp_full_match({t}, '[0-9]+') THEN {t} ELSE {reduced} END"


def skeleton(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({words(x, ' ')}, lambda q_: {skeleton_token('q_')}), ' '), '')"


def plain(x: str, legal: bool = True) -> str:
    ascii_ = f"regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')"
    own = words(f"regexp_replace(replace(lower({ascii_}), '&', ' and '), '[^\\w\\s]', ' ', 'g')")
    if not legal:
        own = f"list_filter({own}, lambda p_: NOT {in_list('p_', tx.SUFFIXES)})"
    return f"coalesce(array_to_string({own}, ' '), '')"


def soundex(x: str, blank: str = "") -> str:
    codes = "translate(l_, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    for d in "123456":
        codes = f"regexp_replace({codes}, '{d}{d}+', '{d}', 'g')"
    return f"list_transform([upper(regexp_replace({x}, '[^a-zA-Z]', '', 'g'))], lambda l_: CASE WHEN l_ = '' THEN '{blank}' ELSE rpad(substr(substr(l_, 1, 1) || replace(substr({codes}, 2), '0', ''), 1, 4), 4, '0') END)[1]"


def postal(address: str, country: str) -> str:
    tail = f"right(trim({address}, ' ' || chr(9) || chr(10) || chr(13)), 15)"

    def shaped(names: list[str]) -> str:
        return "coalesce(" + ", ".join(f"nullif(regexp_extract({tail}, '{tx.POSTAL[n]}', 1), '')" for n in names) + ")"

    known = " ".join(f"WHEN upper({country}) = '{k}' THEN {shaped(v)}" for k, v in tx.POSTAL_OF.items())
    return f"coalesce(nullif(regexp_extract({address}, '{tx.POSTAL_KEYWORD}', 1), ''), CASE {known} ELSE {shaped(list(tx.POSTAL))} END, '')"


def grams(own: str, tag: str) -> str:
    return f"flatten(list_transform({own}, lambda g_: list_transform(range(1, length(g_) + 1), lambda i_: '{tag}' || substr(' ' || g_ || ' ', i_, 3))))"


def bigrams(own: str, tag: str) -> str:
    return f"list_transform(range(1, len({own})), lambda i_: '{tag}' || {own}[i_] || ' ' || {own}[i_ + 1])"


def gram_set(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) + 3), lambda i_: substr('  ' || {x} || '  ', i_, 3)))"


def name_features(name: str, bones: str) -> str:
    """Of the list of words of the name and of its skeleton."""
    return f"list_concat(list_concat({grams(name, 'p')}, {grams(bones, 's')}), list_concat(list_transform({bones}, lambda w_: 'w' || w_), {bigrams(bones, 'b')}))"


def address_features(bones: str) -> str:
    return f"list_concat({bones}, {bigrams(bones, '')})"


def unit_hash(x: str) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0::DOUBLE)"


def f05(n: str, t: str, h: str) -> str:
    return f"CASE WHEN {t} = 0 THEN CASE WHEN {n} = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN {h} = 0 THEN 0.0::DOUBLE ELSE 1.25::DOUBLE * ({h}::DOUBLE / {n}) * ({h}::DOUBLE / {t}) / (0.25::DOUBLE * ({h}::DOUBLE / {n}) + {h}::DOUBLE / {t}) END"


def jaccard(x: str, y: str) -> str:
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"


def levenshtein_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by bit vectors in whole numbers: texts of up to 64 letters."""
    bit = "CAST(pow(2, i_) AS HUGEINT)"
    mask = f"coalesce(list_sum(list_transform(range(length({a})), lambda i_: CASE WHEN substr({a}, i_ + 1, 1) = c_ THEN {bit} ELSE 0::HUGEINT END)), 0)::HUGEINT"
    masks = f"list_transform(string_split({b}, ''), lambda c_: {mask})"
    full = f"(CAST(pow(2, length({a})) AS HUGEINT) - 1)"
    free = f"list_reduce(list_prepend({full}, {masks}), lambda v_, m_: ((v_ + (v_ & m_)) | (v_ - (v_ & m_))) & {full})"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE length({a}) - bit_count({free}) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * ({lcs(a, b)}) / (length({a}) + length({b})) END"


def lcs_similarity(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 100.0::DOUBLE * ({lcs(a, b)}) / greatest(length({a}), length({b})) END"


def _bound(names: dict[str, str], body: str) -> str:
    """``body`` with each name standing for its expression, made once: a lambda over a list of one struct."""
    return f"list_transform([{{{', '.join(repr(n) + ': ' + e for n, e in names.items())}}}], lambda o_: {body})[1]"


def token_sort_ratio(a: str, b: str) -> str:
    def ordered(x: str) -> str:
        return f"coalesce(array_to_string(list_sort({words(x)}), ' '), '')"

    return _bound({"a": ordered(a), "b": ordered(b)}, ratio("o_.a", "o_.b"))


def token_set_ratio(a: str, b: str) -> str:
    def joined(x: str) -> str:
        return f"coalesce(array_to_string(list_sort({x}), ' '), '')"

    x, y = f"list_distinct({words(a)})", f"list_distinct({words(b)})"
    sets = {"s": joined(f"list_intersect({x}, {y})"), "l": joined(f"list_filter({x}, lambda w_: NOT list_contains({y}, w_))"), "r": joined(f"list_filter({y}, lambda w_: NOT list_contains({x}, w_))")}
    p, q = "trim(o_.s || ' ' || o_.l)", "trim(o_.s || ' ' || o_.r)"
    alone = f"greatest(200.0::DOUBLE * length(o_.s) / (length(o_.s) + length({p})), 200.0::DOUBLE * length(o_.s) / (length(o_.s) + length({q})))"
    both = ratio(p, q)
    return _bound(sets, f"CASE WHEN o_.s || o_.l = '' OR o_.s || o_.r = '' THEN 0.0::DOUBLE WHEN o_.s <> '' AND (o_.l = '' OR o_.r = '') THEN 100.0::DOUBLE WHEN o_.s = '' THEN {both} ELSE greatest({both}, {alone}) END")


SCORERS = {"ratio": ratio, "token_sort": token_sort_ratio, "token_set": token_set_ratio, "lcs": lcs_similarity}


def postal_method(address: str, country: str) -> str:
    code = f"nullif(regexp_extract({address}, '{tx.POSTAL_KEYWORD}', 1), '')"
    return f"CASE WHEN {code} IS NOT NULL THEN 'keyword' WHEN {postal(address, country)} <> '' THEN 'pattern' ELSE 'none' END"
