"""Tokens and snippets for retrieval, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.scalar import col, front_matter_list, front_matter_value, without_front_matter

#: Words that are no search terms.
STOPWORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "must", "it", "its", "this", "that", "these", "those", "i", "you", "he", "she", "we", "they",
    "me", "him", "her", "us", "them", "my", "your", "his", "our", "their", "what", "which", "who", "whom", "where", "when", "why", "how", "all",
    "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too", "very",
    "just", "because", "but", "and", "or", "if", "while", "about", "with", "of", "at", "by", "for", "in", "on", "to", "from", "as", "into", "的", "了",
    "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这", "他", "她",
    "它", "们", "那", "些", "什么", "怎么", "如何", "可以", "能", "吗", "呢", "吧", "啊", "哦", "嗯", "这个", "那个", "已经", "还是", "因为", "所以", "但是", "而且", "或者",
)

COMMENT = r"(?s)<!--.*?-->"
MARKUP = r"[#*`\[\]|>_~]"
SEPARATORS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},;:!?。？！，；：（）(){}<>\[\]/\\]+"


CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"


def bigrams(words: Column) -> Column:
    """Words whose runs of Chinese, Japanese or Korean characters are cut into overlapping pairs; single ones stay."""
    runs = F.flatten(F.transform(words, lambda w: F.regexp_extract_all(w, F.lit(f"[{CJK}]+|[^{CJK}]+"), F.lit(0))))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda w: F.when(w.rlike(f"^[{CJK}]"), pairs(w)).otherwise(F.array(w))))


def tokens(text: Column | str, cjk: bool = False) -> Column:
    """The search terms of a text, in order and with repeats: comments, front matter and markup removed, lower case,
    split at white space and punctuation; single characters, numbers and stop words are left out. Null gives none.

    Scripts without word spaces are split at punctuation only or, with `cjk`, into overlapping pairs of characters.
    """
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), COMMENT, "")
    t = F.regexp_replace(without_front_matter(t), MARKUP, " ")
    words = F.split(F.lower(t), SEPARATORS)
    words = bigrams(words) if cjk else words
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\p{Nd}+$"))


def indexable_text(text: Column | str) -> Column:
    """What is indexed of a page: tags and aliases three times, description, title, severity and related modules
    twice, then the body."""
    parts = []
    for key, times in (("tags", 3), ("description", 2), ("title", 2), ("aliases", 3), ("severity", 2), ("related_modules", 2)):
        if key in ("tags", "aliases", "related_modules"):
            listed = F.array_join(front_matter_list(text, key), " ")
            value = F.when(listed != "", listed).otherwise(F.coalesce(front_matter_value(text, key), F.lit("")))
        else:
            value = F.coalesce(front_matter_value(text, key), F.lit(""))
        parts.extend([value] * times)
    parts.append(F.coalesce(without_front_matter(text), F.lit("")))
    return F.array_join(F.filter(F.array(*parts), lambda x: x != ""), "\n")


def snippet(text: Column | str, terms: Column, most: int = 300) -> Column:
    """Four lines around the first line that holds the most terms (one before, two after), at most `most` characters."""
    lines = F.split(without_front_matter(F.coalesce(col(text), F.lit(""))), r"\r?\n")
    score = F.transform(lines, lambda x: F.size(F.filter(terms, lambda t: F.contains(F.lower(x), t))))
    best = F.array_position(score, F.array_max(score)).cast("int")
    first = F.greatest(best - 1, F.lit(1))
    return F.substring(F.trim(F.array_join(F.slice(lines, first, best + 3 - first), "\n")), 1, most)
