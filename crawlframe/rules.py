"""Word lists, extensions, patterns and messages.

Everything here is a default. Each operator takes its rules as parameters, so
a user can pass other lists without touching this file.
"""

# --- fixed values: URL rules -------------------------------------------------

DOCUMENT_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "7z", "tar", "gz",
    "mp3", "mp4", "avi", "mov", "wmv",
    "exe", "msi", "dmg", "app",
]

STATIC_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "bmp", "webp", "svg", "ico",
    "css", "js", "map",
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "rar", "7z", "tar", "gz",
    "mp3", "mp4", "avi", "mov", "wmv", "flv",
    "exe", "msi", "dmg", "app",
]

API_PATTERNS = [
    "/api/", "/ajax/", "/json/", "/xml/", "/rss/",
    "?download=", "&download=", "download.php", "download.asp",
]

URL_HINT_WORDS = {
    "spider": [
        "矿", "地质", "资源", "国土", "自然",
        "mine", "mining", "geology", "resource", "natural",
        "mineral", "coal", "oil", "gas", "exploration",
    ],
    "collector": [
        "矿", "地质", "资源", "国土", "自然", "应急", "安全", "mem",
        "mine", "mining", "geology", "resource", "natural",
        "mineral", "coal", "oil", "gas", "exploration", "emergency", "safety",
    ],
}

INSTITUTION_MARKS = [".gov.", ".org.", ".edu."]

JS_URL_STATIC_EXTENSIONS = ["css", "js", "png", "jpg", "jpeg", "gif", "ico", "pdf", "zip"]
JS_URL_WORDS = ["spa", "angular", "react", "vue", "ajax", "api", "search"]

HTML_CONTENT_TYPES = ["text/html", "application/xhtml+xml", "application/xml", "text/xml"]

BLACKLIST = [
    "facebook.com", "twitter.com", "weibo.com",
    "youtube.com", "bilibili.com", "iqiyi.com", "youku.com", "tudou.com",
    "taobao.com", "tmall.com", "jd.com", "amazon.com", "ebay.com",
    "toutiao.com", "sohu.com", "sina.com", "netease.com",
    "blogspot.com", "wordpress.com",
    "tieba.baidu.com", "zhihu.com",
    "download", "torrent", ".exe", ".zip", ".rar",
    "ad.", "ads.", "analytics.", "tracking.",
    "sports", "entertainment", "fashion", "game",
    "icann", "iana", "rrsg.org", "trustedcomputinggroup.org", "597.com", "lacnic", "osgeo",
]

# --- fixed values: topical keywords ------------------------------------------

SPIDER_KEYWORDS = [
    "矿", "地球化学", "地调", "岩土", "煤业",
    "矿山", "矿业", "矿产", "采矿", "矿井", "矿物", "矿藏", "开采", "矿工", "矿权",
    "煤矿", "金矿", "铁矿", "铜矿", "铝矿", "锌矿", "石油", "天然气", "页岩气",
    "露天开采", "地下开采", "选矿", "冶炼", "矿物加工", "矿山安全", "矿山环保",
    "自然资源", "国土资源", "资源管理", "资源开发", "资源保护", "资源配置",
    "土地资源", "水资源", "森林资源", "海洋资源", "生态资源", "能源",
    "可再生能源", "不可再生资源", "资源勘探", "资源评估", "资源规划",
    "地勘", "cgef", "地震",
    "地质", "地质勘探", "地质调查", "地质环境", "地质灾害", "地质工程",
    "水文地质", "工程地质", "环境地质", "海洋地质", "构造地质", "沉积地质",
    "岩石", "岩层", "地层", "断层", "褶皱", "地壳", "地幔", "板块构造",
    "火山", "滑坡", "泥石流", "地面沉降", "岩溶", "喀斯特",
    "钻探", "物探", "化探", "遥感", "测绘", "地形测量", "gis", "遥感影像",
    "国土资源部", "自然资源部", "地质调查局", "矿产资源", "地质公园",
    "地质博物馆", "勘察设计", "地质勘察", "岩土工程", "地基基础",
    "环境影响评价", "水土保持", "生态修复", "绿色矿山", "智慧矿山",
]

# The collector's list is the spider's list without the first three words below
# and with the others added.
COLLECTOR_DROPPED_KEYWORDS = ["煤业", "地勘", "cgef"]
COLLECTOR_ADDED_KEYWORDS = [
    "应急管理", "应急", "安全", "安全生产", "安全监管", "安全监察",
    "事故", "灾害", "救援", "应急预案", "应急响应", "应急处置",
    "风险评估", "隐患排查", "安全检查", "安全培训", "安全教育",
    "监管", "监察", "执法", "违规", "整改", "处罚",
    "应急管理部", "煤矿安全监察", "安全生产监督管理",
    "mine", "mining", "geology", "resource", "natural",
    "mineral", "coal", "oil", "gas", "exploration",
    "geological", "survey", "earthquake", "volcano",
    "emergency", "safety", "accident", "disaster", "rescue",
    "regulation", "supervision", "inspection",
]
COLLECTOR_KEYWORDS = [
    k for k in SPIDER_KEYWORDS if k not in COLLECTOR_DROPPED_KEYWORDS
] + COLLECTOR_ADDED_KEYWORDS

# Relevance presets: keywords, title words, and the three thresholds
# (distinct keywords matched, weighted score, title words hit).
RELEVANCE_PRESETS = {
    "spider": {
        "keywords": SPIDER_KEYWORDS,
        "title_words": ["安全", "应急", "矿山", "矿", "地质", "资源"],
        "min_matched": 2, "min_score": 3, "min_title": 1,
    },
    "collector": {
        "keywords": COLLECTOR_KEYWORDS,
        "title_words": ["安全", "应急", "矿山", "矿", "地质", "资源", "管理"],
        "min_matched": 3, "min_score": 5, "min_title": 2,
    },
}

# --- fixed values: whitespace -------------------------------------------------

# The characters a Unicode-aware strip() removes, written so that both Java
# regex and RE2 read it alike.
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same characters as plain text, for trimming without a pattern.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: JavaScript-need patterns ----------------------------------

# (name, text that must be there in lower case, pattern)
JS_HTML_PATTERNS = [
    ("script-react", "react", r"<script[^>]*src[^>]*react"),
    ("script-vue", "vue", r"<script[^>]*src[^>]*vue"),
    ("script-angular", "angular", r"<script[^>]*src[^>]*angular"),
    ("script-backbone", "backbone", r"<script[^>]*src[^>]*backbone"),
    ("reactdom-render", "reactdom.render", r"ReactDOM\.render"),
    ("new-vue", "vue(", r"new" + WS + r"+Vue\("),
    ("angular-module", "angular.module(", r"angular\.module\("),
    ("noscript", "<noscript>", r"<noscript>"),
    ("app-root", "<app-root>", r"<app-root>"),
    ("react-root", "<react-root>", r"<react-root>"),
    ("id-app", "app", r"<div[^>]*id=[\"']app[\"']"),
    ("id-root", "root", r"<div[^>]*id=[\"']root[\"']"),
    ("data-src", "data-src=", r"data-src="),
    ("lazy-loading", "lazy", r"loading=[\"']lazy[\"']"),
    ("empty-container", "container",
     r"<div[^>]*class=[\"'][^\"']*container[^\"']*[\"'][^>]*>" + WS + r"*</div>"),
    ("empty-content", "content",
     r"<div[^>]*id=[\"'][^\"']*content[^\"']*[\"'][^>]*>" + WS + r"*</div>"),
]
JS_URL_PATTERNS = ["/spa/", "/app/", "/dashboard/", "/admin/"]
LOADING_WORDS = ["loading", "loader", "spinner", "正在加载", "加载中"]
PLACEHOLDER_TAGS = ["div", "section", "article"]

# --- fixed values: page cleaning ----------------------------------------------

UNWANTED_TAGS = [
    "nav", "header", "footer", "aside", "menu",
    "script", "style", "noscript", "iframe",
    "form", "input", "button", "select", "textarea",
    "advertisement", "sidebar", "banner", "navigation",
]
UNWANTED_CLASSES = [
    "nav", "navigation", "menu", "header", "footer",
    "sidebar", "aside", "banner", "ad", "advertisement",
    "social", "share", "comment", "pagination",
    "breadcrumb", "widget", "toolbar", "popup",
    "top-menu", "main-menu", "sub-menu", "left-menu",
    "right-menu", "bottom-menu", "site-nav", "page-nav",
    "crumb", "crumbs", "bread-crumb", "path-nav",
]
UNWANTED_IDS = [
    "nav", "navigation", "menu", "header", "footer",
    "sidebar", "aside", "banner", "ad", "advertisement",
    "top-nav", "main-nav", "sub-nav", "left-nav",
    "right-nav", "bottom-nav", "site-header", "site-footer",
]
# (kind, value) in order of preference.
MAIN_SELECTORS = [
    ("tag", "main"), ("tag", "article"), ("role", "main"),
    ("class", "content"), ("class", "main-content"), ("class", "article-content"),
    ("class", "post-content"), ("class", "entry-content"), ("class", "page-content"),
    ("id", "content"), ("id", "main-content"), ("id", "article-content"),
]

# --- fixed values: Markdown cleaning and quality ------------------------------

# Texts that mark navigation wherever they occur, and three marks with blanks
# inside, each with the text that must be there for it to match.
NAV_TEXTS = [
    "首页", "主页", "网站首页", "当前位置", "您当前的位置", "您现在的位置",
    "导航", "栏目导航", "网站导航", "面包屑", ">>", "---",
    "更多", "查看更多", "返回", "打印本页", "关闭窗口", "收藏本页", "分享到", "扫一扫",
]
NAV_REGEXES = [
    ("首页", r"位置" + WS[:-1] + r":：]*首页"),
    (">", r">" + WS + r"*>"),
    ("|", r"\|" + WS + r"*\|"),
]
NAV_EXACT_LINES = ["首页", "上一页", "下一页", "更多", "返回", "打印", "关闭", "分享"]
NAV_RULE_LINE = r"^" + WS[:-1] + r"|>\-─│├┤┴┬┼—–]*$"
NAV_SHORT_WORDS = ["首页", "导航", "菜单", "更多"]

DOMAIN_WORDS = [
    "矿", "地质", "自然资源", "地理", "勘探", "地调",
    "矿物", "地壳", "岩石", "地层", "水文", "环境",
    "测绘", "规划", "管理", "保护", "开发", "利用",
]
SUBSTANTIAL_CLASS = r"[\x{4e00}-\x{9fff}a-zA-Z0-9]"

# --- fixed values: texts shown to users ---------------------------------------

NO_TITLE = "无标题"
UNKNOWN_ERROR = "未知错误"
FAILED_PAGE_TITLE = "失败页面"
MSG_NOT_HTML = "非HTML内容类型: "
MSG_NOT_TEXT = "响应内容不是文本格式"
MSG_TOO_SHORT = "HTML内容为空或过短"
MSG_OFF_TOPIC = "页面内容与目标主题不相关"
MSG_TIMEOUT = "请求超时 ({}秒)"
MSG_REQUEST = "请求异常: "
MSG_UNKNOWN = "未知错误: "
MSG_SAVE_FAILED = "保存文件失败"

RUN_STATUS_TEXT = {
    "running": "抓取运行中",
    "finished_with_errors": "抓取完成（有错误）",
    "finished": "抓取完成",
    "idle": "系统空闲",
}

CHARSET_CANDIDATES = ["utf-8", "gb2312", "gbk", "gb18030"]
