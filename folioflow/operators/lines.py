"""Line, body and error rules: advert lines, reusable bodies, page and error classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS_INLINE, _col, clean_lines, is_blank, replace_all, trim_u

# Markers of advert lines, one named rule set each.
AD_MARKERS = {
    "paged_list": ["笔趣阁小说网", "biquge", "第(", "页"],
    "key_hints": ["按键盘上方向键", "未阅读完", "加入书签", "已便下次继续阅读", "更多原创手机电子书", "免费TXT小说下载"],
    "next_page": ["shuhaige.net", "书海阁", "点击下一页", "最新网址"],
    "votes": ["起点中文网", "www.qidian.com", "手机用户请到", "推荐票", "月票"],
    "numbered_host": ["biquge345", "笔趣阁小说网"],
    "short_host": ["ixdzs"],
    "spaced": ["首发无广告", "请分享", "读之阁", "小说网", "首发地址", "手机阅读", "一笔阁", "site_con_ad", "chapter_content"],
    "browser_hint": ["(ò﹏ò)", "抱歉，章节内容不支持", "为了使用完整的阅读功能", "请考虑使用", "Chrome 谷歌浏览器",
                     "Safari 苹果浏览器", "Edge 微软浏览器", "谢谢!!!"],
}
# Rule sets that fold case, also test the line without spaces, or drop blank lines.
AD_FOLD_CASE = {"next_page"}
AD_COMPACT = {"spaced"}
AD_DROP_BLANK = {"key_hints", "next_page", "numbered_host", "short_host", "browser_hint"}
# Look-alike characters of an obfuscated address line, by position.
LOOKALIKES = ["8⑧⑻⒏８", "NΝＮｎ", "OoοσОＯｏ", "vνＶ", "EΕЁЕヨＥｅ", "L└┕┗Ｌｌ", ".·。．", "CcСсＣｃ", "oΟοОоＯ", "mмｍ"]
LOOKALIKE_MISSES = 2
# Navigation lines, load-failure phrases, chapter end mark.
NAVIGATION = ["上一章", "目录", "下一章"]
LOAD_FAILURES = ["（内容加载失败！）", "(内容加载失败！)", "内容加载失败！"]
CHAPTER_END = "(本章完)"
# Placeholder words of images without text, and invisible characters.
IMAGE_WORDS = ["插图", "插圖", "图片", "圖片", "??"]
INVISIBLE_BODY = ["\u200b", "\u200c", "\u200d", "\ufeff"]
# Markers of pages without readable text.
PAGE_MARKERS = {
    "login": ["會員登入", "登入 / 註冊", "/my/login"],
    "password": ["btn-send-pw", "oops_art.jpg", "forum_pw.php"],
    "locked": ["vip-limit-wrap", "需要订阅", "订阅本章", "请登录后", "登录后阅读", "本章为VIP章节"],
    "probe": ["/C2WF946J0/probe.js", 'var buid = "ffffffff'],
}
# Words of fetch errors.
RETRY_WORDS = ["context deadline exceeded", "client.timeout", "timeout awaiting headers", "http 403", "http 408",
               "http 425", "http 429", "http 500", "http 502", "http 503", "http 504", "unexpected eof", " eof",
               "connection reset", "forcibly closed", "actively refused"]
GONE_WORDS = ["http 404", "http 405", "http 410", "http 520"]


def contains_any(c: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(c, F.lit(m))
    return out


def is_ad_line(line: Column | str, rule: str) -> Column:
    """Whether a line is an advert under one of the named rule sets."""
    x = _col(line)
    text = F.lower(trim_u(x)) if rule in AD_FOLD_CASE else x
    hit = contains_any(text, AD_MARKERS[rule])
    if rule in AD_COMPACT:
        hit = hit | contains_any(F.replace(x, F.lit(" "), F.lit("")), AD_MARKERS[rule])
    return hit | is_blank(x) if rule in AD_DROP_BLANK else hit


def is_lookalike_line(line: Column | str) -> Column:
    """Same length as the obfuscated address, and at most two positions outside the allowed sets."""
    x = trim_u(line)
    misses = F.lit(0)
    for i, allowed in enumerate(LOOKALIKES, 1):
        misses = misses + F.when(F.contains(F.lit(allowed), F.substring(x, i, 1)), 0).otherwise(1)
    return (F.char_length(x) == len(LOOKALIKES)) & (misses <= LOOKALIKE_MISSES)


def is_navigation_line(line: Column | str) -> Column:
    return trim_u(line).isin(*NAVIGATION)


def is_page_indicator(line: Column | str) -> Column:
    return trim_u(line).rlike(r"(?s)^第\((?=.*/).*\)页\z")


def drop_load_failures(text: Column | str) -> Column:
    return trim_u(replace_all(_col(text), [(p, "") for p in LOAD_FAILURES]))


def keep_lines(lines: Column, drop) -> Column:
    """Array of lines without those for which `drop` holds."""
    return F.filter(lines, lambda x: ~drop(x))


def clean_body_lines(body: Column | str, rule: str, end_mark: str | None = CHAPTER_END) -> Column:
    """Cleaned lines of a body without adverts; the chapter end mark is cut from line ends."""
    kept = keep_lines(clean_lines(body), lambda x: is_ad_line(x, rule))
    if end_mark:
        kept = F.transform(kept, lambda x: F.when(F.endswith(x, F.lit(end_mark)), trim_u(
            F.substr(x, F.lit(1), F.char_length(x) - len(end_mark)))).otherwise(x))
    return F.filter(kept, lambda x: x != "")


def marked_lines(lines: DataFrame, rules: DataFrame, text: str = "line", site: str = "site") -> DataFrame:
    """Flag lines by a caller's (site, marker) rule table.  The markers of a source are folded into
    one array first, so a line meets its source once and is never paired with every marker."""
    per_site = rules.groupBy(site).agg(F.collect_set("marker").alias("_markers"))
    hit = F.exists("_markers", lambda m: F.contains(F.col(text), m))
    return (lines.join(per_site, site, "left")
            .withColumn("is_ad", F.coalesce(hit, F.lit(False))).drop("_markers"))


def is_reusable(content: Column | str) -> Column:
    """A stored body is reusable when it has visible text and no image-placeholder line."""
    x = replace_all(F.coalesce(_col(content), F.lit("")), [("\r\n", "\n"), *[(i, "") for i in INVISIBLE_BODY]])
    words = "|".join(w.replace("?", r"\?") for w in IMAGE_WORDS)
    ws = rf"[{WS_INLINE}]*"
    placeholder = x.rlike(rf"(?:^|\n){ws}\[(?:{words})\](?:{ws}(?:\n|\z)| [^\n]*[^\n{WS_INLINE}])")
    return ~placeholder & ~is_blank(x)


def is_reusable_for(content: Column | str, min_length: Column | int) -> Column:
    """`is_reusable`, and at least `min_length` characters after cleaning (0 means no minimum)."""
    n = F.lit(min_length) if isinstance(min_length, int) else F.coalesce(min_length, F.lit(0))
    x = trim_u(replace_all(F.coalesce(_col(content), F.lit("")), [("\r\n", "\n"), ("\r", "\n"), ("\u200b", ""), ("\ufeff", "")]))
    return is_reusable(content) & ((n <= 0) | (F.char_length(x) >= n))


def page_status(markup: Column | str) -> Column:
    x = _col(markup)
    out = F.lit("ok")
    for status in reversed(list(PAGE_MARKERS)):
        out = F.when(contains_any(x, PAGE_MARKERS[status]), F.lit(status)).otherwise(out)
    return out


def error_class(message: Column | str) -> Column:
    """`retry`, `gone` (fall back to another copy) or `fatal`; empty for no error."""
    m = F.lower(F.coalesce(_col(message), F.lit("")))
    return (F.when(m == "", F.lit("")).when(contains_any(m, RETRY_WORDS), F.lit("retry"))
            .when(contains_any(m, GONE_WORDS), F.lit("gone")).otherwise(F.lit("fatal")))


def warning_class(message: Column | str) -> Column:
    m = F.lower(F.coalesce(_col(message), F.lit("")))
    return (F.when(contains_any(m, ["context deadline exceeded", "timeout"]), F.lit("timeout"))
            .when(F.contains(m, F.lit("http 403")), F.lit("blocked")).otherwise(F.lit("other")))
