"""The word lists, patterns and priorities that results depend on."""

# White space as the catalogue's text rules mean it (wider than Java's \s).
SPACE = "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"

# What separates the artists of a joint credit; a credited guest; a member of a group.
COLLAB_SPLIT = f"(?i){SPACE}*[&＆,×｜]{SPACE}*|{SPACE}+with{SPACE}+|{SPACE}+meets{SPACE}+|{SPACE}*feat\\.{SPACE}*"
GUEST = f"(?i){SPACE}*\\({SPACE}*(?:feat|prod)\\.{SPACE}*([^()]+?){SPACE}*\\){SPACE}*"
HAS_GUEST = f"(?i)\\({SPACE}*(?:feat|prod)\\.{SPACE}*[^()]+?\\)"
MEMBER_OF = f"(?i){SPACE}+of{SPACE}+"
PIPE = "｜"

# Scripts by code points.
KANA = "[\\u3040-\\u309F\\u30A0-\\u30FF\\uFF66-\\uFF9F]"
HAN = "[\\u3400-\\u4DBF\\u4E00-\\u9FFF]"
HANGUL = "[\\uAC00-\\uD7AF\\u1100-\\u11FF\\u3130-\\u318F]"

# Sources by their standing, and who owns which field.
SOURCE_RANK = {"blog": 1, "namu": 2, "tj": 3}
NAME_OWNERS = ("tj", "blog", "namu")
KOREAN_OWNERS = ("blog", "namu", "tj")
VENDORS = ("tj", "ky", "joysound")

# Of these categories the first one present removes the others.
CATEGORY_PRIORITY = ("vocaloid", "anime", "jpop")
POST_CATEGORY = {"101": "jpop", "105": "jpop", "112": "jpop"}

# Artists (as match keys) that are never admitted.
KOREAN_DROPPED = (
    "aespa", "akmu", "akmu(악뮤)", "bigbang", "blackpink", "bts", "enhypen", "exo", "exo-cbx", "exo-k", "exo-m", "ftisland",
    "girls'generation", "girlsgeneration", "iu", "ive", "ive(아이브)", "iz*one", "izone", "j-walk", "jwalk", "kara", "lesserafim",
    "lump", "nctwish", "newjeans", "parkhyoshin", "plave", "redvelvet", "seventeen", "shinee", "snsd", "straykids", "sugaofbts",
    "superjunior", "tohoshinki", "tvxq", "twice", "少女時代", "東方神起", "防弾少年団", "뉴진스", "동방신기", "램프", "레드벨벳",
    "르세라핌", "박효신", "방탄소년단", "블랙핑크", "빅뱅", "샤이니", "세븐틴", "소녀시대", "슈퍼주니어", "스트레이키즈", "아이브",
    "아이유", "아이즈원", "악동뮤지션", "에스파", "에프티아일랜드", "엑소", "엔시티위시", "엔하이픈", "정국", "카라", "트와이스",
)
CHINESE_DROPPED = ("b.a.d", "beyond", "f.i.r.", "f4", "marry-m", "nzbz", "r1se", "s.h.e", "twins")

# Spellings of a name, and the one that stands for them.
CANONICAL_NAMES = {
    "Dreams Come True": "DREAMS COME TRUE",
    "Unison Square Garden": "UNISON SQUARE GARDEN",
    "BOA": "BoA",
    "LISA": "LiSA",
    "Bump of Chicken": "BUMP OF CHICKEN",
    "Mrs. Green Apple": "Mrs. GREEN APPLE",
    "Judy and Mary": "JUDY AND MARY",
    "Judy And Mary": "JUDY AND MARY",
    "Kinki Kids": "KinKi Kids",
    "Kinki kids": "KinKi Kids",
    "PEOPLE 1": "People 1",
    "Ano": "ano",
    "Chemistry": "CHEMISTRY",
    "Luna Sea": "Luna sea",
    "タッキー&翼": "タッキー＆翼",
    "Lia": "LIA",
    "Hitomi": "hitomi",
    "TK from 凛として時雨": "TK From 凛として時雨",
    "I WiSH": "I WISH",
    "4 In love": "4 In Love",
}

# Votes for a verdict, how long state stays fresh, and sizes of the reports.
LEAST_VOTES, MAJORITY_OF_TEN = 3, 7
ENTRY_DAYS, BOOTSTRAP_DAYS = 90, 7
CONFLICT_SAMPLE, ALIAS_SAMPLE, RESULT_CAP = 10, 5, 50
