"""Fixed values. They decide results, so they are stated here as plain text in their natural order.
Every operator takes them as parameters; another language supplies its own."""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: predicate lexicons -------------------------------------------------------
ITINERARY = (
    "访问", "出席", "前往", "抵达", "行程", "会见", "开展", "检查", "调研", "考察", "将于", "计划",
    "visit", "attend", "travel",
)
STATEMENT = ("表示", "称", "指出", "强调", "宣布", "说", "statement", "said", "says", "announced")
OTHER = (
    "获颁", "获赠", "获得", "赢得", "当选", "就任", "担任", "卸任", "辞去", "逝世", "去世", "被任命", "任命为",
)
EVENT_TYPES = ("itinerary", "statement", "other")

# --- fixed values: extraction patterns ------------------------------------------------------
QUOTE = "[“\"]([^”\"]{4,400})[”\"]"
SENTENCE_END = "。！？!?"
CLOSING_QUOTE = "”\""
CLAUSE_MARKS = "\n。！？!?；;"
INDEX_LINE = "(?:国内|国际)?活动更多>>\\s*"
INLINE_DATE = "\\s+(?=20\\d{2}[-/.年]\\d{1,2}[-/.月]\\d{1,2}日?)"
PRONOUN_LEAD = "^(?:他|她)(?:表示|指出|强调|宣布|称|说)"
DATED_PRONOUN_LEAD = "^(?:20\\d{2}年\\d{1,2}月\\d{1,2}日[，,]?\\s*)?(?:他|她)(?:表示|指出|强调|宣布|称|说)"
PLACE = (
    "(?:在|前往|抵达|访问)([\\u4e00-\\u9fffA-Za-z·、\\s]{2,30}?)"
    "(?=举行|出席|访问|会见|表示|指出|强调|宣布|开展|进行|调研|考察|检查|主持|召开)"
)
PLACE_HELD = "举行"
PLACE_TAIL = "在"
PLACE_TRIM = "，。, ."
PLACE_ALIASES = {"首尔总统府": "韩国总统府"}
# {name} stands for the quoted name; a mention inside a match is background, not the subject.
BACKGROUND = (
    "以[^，。；]{0,8}{name}[^，。；]{0,36}(?:为指导|为指引|精神)",
    "(?:学习|贯彻|落实|遵循)[^，。；]{0,16}{name}[^，。；]{0,36}(?:讲话|论述|思想|精神|指示|要求)",
    "{name}(?:主席|总书记)?(?:的)?(?:特使|代表|思想|精神|论述|指示|要求)[^，。；]{0,30}",
    "(?:请[^，。；]{0,12})?(?:转达|代转)(?:对)?[^，。；]{0,8}{name}"
    "(?:主席|总书记)?(?:的)?[^，。；]{0,20}(?:问候|祝愿|致意|慰问)",
)
SUBJECT_GAP = 72
MIN_SEGMENT = 6
HEDGES = ("据称", "可能", "预计", "传闻", "或将")
RUMOR_HEDGES = ("传闻", "据称")
UNTITLED = "未命名材料"
UNTITLED_ENTRY = "未命名条目"

# --- fixed values: text that the dedup key ignores ------------------------------------------
DATELINE = "^(?:新华社|中新社|本报|本刊)[^。]{0,80}?(?:电|讯)\\s*"
REPORTER = "^[（(]记者[^）)]{1,80}[）)]\\s*"
LEADING_DAY = "^\\d{1,2}月\\d{1,2}日[，,]?\\s*"
NOT_CORE = "[^\\u4e00-\\u9fffA-Za-z0-9]"
CONTAINED_CHARS = 24
SIMILAR_ENOUGH = 0.72

# --- fixed values: publication dates --------------------------------------------------------
URL_DATES = (
    "/(20\\d{2})(\\d{2})(\\d{2})(?:/|$)",
    "/(20\\d{2})/(\\d{2})/(\\d{2})(?:/|$)",
    "/(20\\d{2})/(\\d{2})(\\d{2})(?:/|$)",
)
BODY_DATES = (
    "(20\\d{2})年(\\d{1,2})月(\\d{1,2})日(?:\\s*(\\d{1,2}):(\\d{2}))?",
    "(20\\d{2})[-/.](\\d{1,2})[-/.](\\d{1,2})(?:[ T](\\d{1,2}):(\\d{2}))?",
)
FUTURE_AFTER = (
    "起施行", "起生效", "起执行", "起实施", "起公布", "起试行", "正式施行", "正式实施", "之日起",
)
FUTURE_BEFORE = ("将于", "预计", "拟于", "计划于")

# --- fixed values: page cleaning and quality ------------------------------------------------
ARTICLE_END = (
    "(责编：", "（责编：", "责任编辑：", "编辑：", "分享让更多人看到", "客户端下载", "相关阅读",
    "相关新闻", "推荐阅读", "更多精彩内容", "版权声明", "免责声明", "违法和不良信息举报",
)
DISPATCH_LEAD = "(?:新华社|中新社|本报|本刊)[^\\s。]{1,50}(?:电|讯)"
TOOLBAR_DOMAIN = "people.com.cn"
TOOLBAR_LEAD = "^(?:打开\\s+)?(?:登录|订阅|取消订阅|已收藏|收藏|大字号|小字号)\\s+"
NAVIGATION = (
    "news", "politics", "government", "gov", "leadership", "current", "list", "index",
    "新闻", "时政", "政务", "领导", "活动", "要闻", "资讯",
)
NAVIGATION_LEAVES = (
    "", "index", "index.html", "index.htm", "index.shtml", "default.html", "home.html",
)
ARTICLE_SUFFIXES = (".html", ".htm", ".shtml")
NAVIGATION_PATHS = ("list", "index", "channel", "search", "news", "politics", "gov")
NAVIGATION_TITLES = (
    "首页", "专题首页", "最新播报", "评论解读", "智库报告", "权威速览", "要点海报", "学习快评",
    "更多>>", "更多 >",
)
SKIPPED_SUFFIXES = (
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".zip", ".rar", ".mp3", ".mp4",
    ".avi", ".css", ".js", ".xml",
)
SECOND_LEVEL = ("com.cn", "org.cn", "net.cn", "gov.cn", "edu.cn")
# host suffix of the root page -> hosts that count as the same site, and its search page
SITE_PROFILES = (
    ("www.gov.cn", ("www.gov.cn", "sousuo.www.gov.cn"),
     "https://sousuo.www.gov.cn/sousuo/search.shtml?code=17da70961a7&dataTypeId=107&searchWord={query}"),
    ("people.com.cn", ("people.com.cn",), "http://search.people.cn/s/?keyword={query}"),
    ("xinhuanet.com", ("xinhuanet.com", "news.cn"), "https://so.news.cn/#search/0/{query}/1/0"),
    ("news.cn", ("xinhuanet.com", "news.cn"), "https://so.news.cn/#search/0/{query}/1/0"),
)
GATEWAY_HOST = "big5.www.gov.cn"
GATEWAY_PATH = "/gate/big5/www.gov.cn/"
GATEWAY_TARGET = "https://www.gov.cn/"
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("fbclid", "gclid")

REASONS = {
    "navigation": "URL 或标题指向栏目/首页",
    "title": "标题缺失或异常过长",
    "title_navigation": "标题包含多个导航栏目",
    "short": "正文过短",
    "family_channel": "中国日报 URL 指向首页或频道",
    "family_title": "中国日报标题包含页面导航",
    "family_body": "中国日报正文仍含密集页面导航",
    "aggregate": "页面缺少发布时间且正文呈导航聚合结构",
}

# --- fixed values: digest texts -------------------------------------------------------------
TYPE_LABELS = {"itinerary": "行程", "statement": "言论", "other": "其他"}
STATE_LABELS = {
    "rumored": "存疑", "expected": "预计", "confirmed": "已确认", "ongoing": "进行中",
    "completed": "已发生", "cancelled": "已取消", "disputed": "有争议", "pending": "待审核",
    "approved": "已通过", "rejected": "已驳回", "needs_review": "需复核",
}
TIME_UNKNOWN = "时间未知"
PLACE_UNKNOWN = "未披露"
SOURCE_UNKNOWN = "来源未知"
NOTHING_NEW = "本期没有符合规则的公开动态。"
ITEM_SKIPPED = "事件已删除或被驳回"
LOCAL_ZONE = "Asia/Shanghai"


@dataclass(frozen=True)
class Limits:
    """Characters that an operator looks at or keeps, and pages it walks. None: all of them, which is the default
    everywhere. A limit changes results: what lies beyond it is neither compared nor stored."""

    key: int | None = None
    similar: int | None = None
    dated: int | None = None
    relevant: int | None = None
    framed: int | None = None
    aggregated: int | None = None
    title: int | None = None
    author: int | None = None
    language: int | None = None
    summary: int | None = None
    evidence: int | None = None
    stored_summary: int | None = None
    stored_evidence: int | None = None
    place: int | None = None
    quote: int | None = None
    zone: int | None = None
    report: int | None = None
    snippet: int | None = None
    error: int | None = None
    audit: int | None = None
    pages: int | None = None
    depth: int | None = None
    unset_pages: int | None = None
    unset_depth: int | None = None
    pages_per_item: int | None = None
    candidates_per_item: int | None = None
    batch_events: int | None = None


ALL = Limits()
# fixed values: the limits of a small installation, for those who want its results
SMALL = Limits(key=80, similar=240, dated=5000, relevant=4000, framed=800, aggregated=1200, title=500, author=200, language=30,
               summary=500, evidence=1000, stored_summary=2000, stored_evidence=2000, place=300, quote=2000, zone=50, report=300,
               snippet=300, error=500, audit=1000, pages=50, depth=2, unset_pages=12, unset_depth=1, pages_per_item=3, candidates_per_item=4, batch_events=100)


@dataclass(frozen=True)
class Lexicon:
    """The language-dependent part of event extraction."""

    itinerary: tuple[str, ...] = ITINERARY
    statement: tuple[str, ...] = STATEMENT
    other: tuple[str, ...] = OTHER
    quote: str = QUOTE
    sentence_end: str = SENTENCE_END
    clause_marks: str = CLAUSE_MARKS
    pronoun_lead: str = PRONOUN_LEAD
    dated_pronoun_lead: str = DATED_PRONOUN_LEAD
    place: str = PLACE
    place_aliases: dict[str, str] = field(default_factory=lambda: dict(PLACE_ALIASES))
    background: tuple[str, ...] = BACKGROUND

    def words(self, event_type: str) -> tuple[str, ...]:
        return getattr(self, event_type)


# --- fixed values: one site family's domain, page frame and channels ----------------------------
@dataclass(frozen=True)
class SiteFamily:
    """One domain family whose pages need extra cleaning and extra quality tests."""

    domain: str = "chinadaily.com.cn"
    markers: tuple[str, ...] = (
        "中国日报网首页", "中国日报中文网", "China Daily", "首页", "时政", "资讯", "地方", "国际",
        "财经", "文化", "图片", "视频", "客户端", "English",
    )
    toolbar_start: str = "站内搜索"
    toolbar_end: str = "分享到(?:微信|：)?"
    channels: tuple[str, ...] = ("", "/china", "/world", "/business", "/culture", "/video", "/photo")
