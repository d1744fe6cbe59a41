"""Word lists and weights.  Every operator takes them as parameters; these are the defaults."""

from __future__ import annotations

# Results depend on these words exactly.
EN_STOPWORDS = """
the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should
may might shall can need dare it its this that these those i me my we our you your he him his she her they them their what which
who whom how when where why all each every both few more most other some such no not only same so than too very just also about up
out then there here now like know think see get got go going come one two time year make way even well back still good new first
last long great little own right old big high lol lmao haha hahaha im ive dont cant thats youre theyre wont wasnt didnt doesnt
""".split()
KO_STOPWORDS = "이 가 을 를 은 는 에 에서 도 의 와 과 로 으로 이다 이고 에게 한테 께 보다 처럼 있다 없다 하다 되다 같다 그 저 이것 그것 저것 거 것 수 좀 더 제 그냥 진짜 너무 정말 또 다 잘 못 안 왜 어".split()
STOPWORDS = EN_STOPWORDS + KO_STOPWORDS
MATCH_STOPWORDS = "이다 있다 없다 하다 되다 같다 있어 있는 있습니 있네요 있네 하는 하고 하니 해서 했다 했어 했네 이런 그런 저런 어떤 정말 너무 진짜 완전 그냥 좀 이번 오늘 지금 아직 다시 또 이걸 저걸 그걸 합니다 이에요 인데요 네요 이고 이며 에서 으로 에게".split()

# Labels and the substrings that give them.
SENTIMENT = {
    "positive": "amazing|awesome|beautiful|best|brilliant|excellent|fantastic|good|great|incredible|love|loved|lovely|nice|outstanding|perfect|superb|wonderful|wow|impressive|stunning|unbelievable|insane|goat|legend|legendary|clutch|epic|좋아|최고|대박|짱|완벽|훌륭|멋지|최강|굿|레전드|갓|미쳤다|미쳐|대단|역시".split("|"),
    "negative": "awful|bad|boring|disappointing|disgusting|dull|frustrating|horrible|mediocre|poor|terrible|trash|waste|worst|wrong|disappointed|sucks|rip|별로|실망|최악|형편없|아쉽|못해|진짜별로|노재미|노잼".split("|"),
    "surprise_excitement": "omg|whoa|no way|unreal|crazy|insane|wild|mind blown|mindblown|shocked|stunning|헐|와|대박|미쳤|실화|진심|어머".split("|"),
    "cheering_support": "go|lets go|let's go|come on|you can do it|fighting|support|cheer|rooting|believe|keep going|keep it up|화이팅|파이팅|응원|힘내|기대|잘해".split("|"),
    "criticism": "should have|could have|would have|missed|wasted|overrated|overhyped|inconsistent|mistake|error|blunder|why didnt|why didn't|poor shot|dropped|아쉽다|왜저래|실수|왜이래|별로다".split("|"),
}
CATEGORIES = {
    "dramatic": "역전|반전|한방에|무너지|무너졌|끝날때까지|끝난게아니|드라마|극적|역전패|역전승|역대급|뒤집|뒤집었|멘탈나|멘탈붕괴|한홀에|한 홀에|3타차를|타차를|끝날때까지끝난게|comeback|reversal|dramatic|unbelievable|choke|collapse".split("|"),
    "controversial": "비매너|시간 끈|시간끈|끈다고|인터벌|시간 제한|시간제한|시간 끌|팀조합|팀 구성|팀구성|선발 기준|선발기준|나오지말아야|못나오고|예선광탈|탑10에도못|성적 조합|평균 성적 조합|규정|논란|문제있|공정|반칙|unsportsmanlike|slow play|controversy|unfair".split("|"),
    "analytical": ";;|감정기복|감정 기복|나대는|나댄다|나대고|과하게|과한 것|과한것|발랄하더니|분위기 이상|분위기이상|개정색빨면서|찾아가서|배우시길|개선하|볼스|스크린의|선발기준|팀조합|경기 운영|경기운영|멘탈 관리|멘탈관리|봐주기에는|봐주기엔".split("|"),
    "funny": "ㅋㅋ|ㅎㅎ|ㅋㄱ|lol|lmao|haha|hilarious|funny|cringe|😂|🤣".split("|"),
    "critical": "실망|왜저래|왜이래|별로|형편없|프로가맞나|프로답지|수준이|기대이하|기대 이하|안되겠|안되겠다|이제진짜|진짜안되|아마추어|아마한테도|아마보다|아마도질|프로대아마|아마로 나가|아마로나가|나가야될|나가야 될|못해|못하는|disappointing|terrible|awful|poor|bad shot".split("|"),
    "clutch_hype": "대박|굿샷|짱|하드캐리|클러치|레전드|갓|미쳤다|미쳐|최고|완벽|멋지|awesome|clutch|legendary|goat|amazing|insane|incredible|🔥".split("|"),
    "emotional": "ㅠㅠ|ㅜㅜ|눈물|감동|마음이|가슴이|울었|안타깝|슬프|애잔|가슴아프|눈물겹|귀여워|귀여운|귀엽|부럽|부러워|😢|😭|heartbreaking|touching".split("|"),
    "supportive": "화이팅|파이팅|응원|힘내|기대해|수고|고생하셨|잘했|잘하|잘해|응원합니다|fighting|support|well done|good job|keep going".split("|"),
}
CONTRAST = ["좋은데,", "좋은데 ", "하지만", "근데 ", "그런데 ", "않았음", "않았나", "않았어", "감이 없지", "감이없지", "나대는", "과하게", "발랄하더니"]
USAGE = {
    "dramatic": "open_short_with_hook_card",
    "controversial": "standalone_debate_short",
    "analytical": "context_card_before_clip",
    "funny": "overlay_on_funny_clip",
    "critical": "pair_with_mistake_clip",
    "clutch_hype": "overlay_on_highlight_clip",
    "emotional": "cut_to_player_reaction",
    "supportive": "close_short_with_fan_voice",
    "representative": "mid_roll_summary_card",
}
#: In hundredths, so that sums are exact.
CATEGORY_WEIGHT = {"dramatic": 150, "controversial": 140, "analytical": 135, "funny": 130, "critical": 120, "clutch_hype": 110, "emotional": 100, "representative": 90, "supportive": 80}
CONFIDENCE_BONUS = {"high": 5, "medium": 3, "low": 1, "none": 0}
ACTS = {
    "act_1_opening": "시작|첫|1번홀|첫홀|오프닝|개막|출전|나왔|등장|처음|시작하".split("|"),
    "act_2_buildup": "리드|따라잡|동타|타차|점수|스코어|버디|파|보기|이글".split("|"),
    "act_3_turning": "역전|반전|무너지|한홀에|뒤집|흔들|ob|아웃오브|뒷땅|생크|comeback|turning|pivotal".split("|"),
    "act_4_climax": "홀인원|이글|하드캐리|대박|미쳤|신|완벽|클러치|결정적|최고|hole in one|amazing|incredible|insane".split("|"),
    "act_5_closing": "우승|최종|결과|끝|수고|고생|화이팅|응원|다음|다음번|기대|잘했".split("|"),
}
ACT_OF_CATEGORY = {"dramatic": "act_3_turning", "controversial": "act_3_turning", "clutch_hype": "act_4_climax", "emotional": "act_5_closing", "supportive": "act_5_closing"}
EVENT_WORDS = "ob|아웃오브바운즈|뒷땅|뒤땅|탑볼|쏙땅|생크|버디|파|보기|더블|이글|홀인원|알바트로스|birdie|eagle|bogey|par|hole in one|역전|반전|리드|따라잡|동타|타차|comeback|lead|tied|chip-in|chip in|putt|벙커|러프|페어웨이|그린|핀|워터|bunker|rough|fairway|green|pin|water".split("|")
REACTIONS = {"웃음(ㅋ)": "웃음·재미", "웃음(ㅎ)": "웃음·가벼운", "안타까움(ㅠ)": "안타까움·슬픔", "대박": "감탄·대박", "역전": "역전 장면", "동타": "동타 장면", "역시": "기대 충족", "화이팅": "응원·격려", "진짜": "강조·감탄"}
LOGISTICS = "내일 모레 언제 어디서 어디 몇시 예약 코스 볼스 볼스코어 라운드예약 내주 다음주 방문 연락 인스타 구독 멤버십 후원 슈퍼챗 채팅 댓글 유튜브 영상올려 편집 업로드 언제나와".split()
BROADCAST = "OB ob 오비 아웃 버디 이글 알바 홀인원 파 보기 더블 트리플 동타 역전 연장 우승 퍼트 퍼터 드라이버 뒷땅 티샷 어프로치 그린 러프 페어웨이 18홀 17홀 16홀 15홀 최종홀 막홀 샷 나이스샷 나이스 장타 홀 라운드 스코어 언더 오버 해설 선수 경기".split()
# Forms of a name that an alias may be known by; what a display name may end in.
TITLE_FORMS = ["프로", "선수", "프로님", "선수님"]
BASE_FORMS = ["프로", "선수", "프로님", "선수님", "형"]
DISPLAY_ENDINGS = [" 프로", " 선수", " 코치", " 감독", "님"]
# Words of chat and what event they stand for; events that one mention doesn't prove.
EVENTS_OF = {
    "OB": "OB",
    "ob": "OB",
    "오비": "OB",
    "아웃": "OB",
    "버디": "버디",
    "이글": "이글",
    "알바": "알바트로스",
    "홀인원": "홀인원",
    "파": "파",
    "보기": "보기",
    "더블": "더블보기",
    "트리플": "트리플보기",
    "동타": "동타(타이)",
    "역전": "역전",
    "연장": "연장전",
    "우승": "우승",
    "퍼트": "퍼트",
    "퍼터": "퍼터",
    "드라이버": "드라이버 샷",
    "뒷땅": "뒷땅",
    "티샷": "티샷",
    "어프로치": "어프로치",
    "그린": "그린",
    "러프": "러프",
    "페어웨이": "페어웨이",
    "18홀": "18번홀",
    "17홀": "17번홀",
    "16홀": "16번홀",
    "15홀": "15번홀",
    "최종홀": "최종홀",
    "막홀": "최종홀",
    "샷": "샷",
}
SURE_EVENTS = ["우승", "홀인원", "연장전"]
# An event that is wished for (group 1), and what around a word says that it isn't happening now.
CHEER = r"(우승|역전)\s*(홧팅|화이팅|파이팅|응원|기원|힘내|바랍니다|하세요|해요|하길|하시길|되시길|기도|하자|바람|바라|가즈아|가자)"
NOT_NOW = r"(해야|하면|했을\s*때|안\s+하|를\s*못|두\s+개|세\s+개|두\s+번|잖아요|잖습니다|때도|아냈고|았고\s)"
# Words of commentary that excite, and tense ones; words of chat about a newcomer, of praise and of lasting interest.
EXCITED = ["굉장히", "정말", "대단", "소름", "인상적", "대박", "놀랍", "완벽", "최고", "환상적", "역대급", "믿을", "어마어마"]
TENSE = ["아슬", "위험", "아깝", "간신히", "겨우", "아 진짜", "불안"]
NEWCOMER = ["다크호스", "몰랐", "누구", "처음", "신인", "신인왕", "루키"]
PRAISE = ["ㄷ", "대박", "장타", "이글", "버디", "홀인원", "기대", "잘한다", "잘하네"]
LASTING = ["앞으로", "기억", "기대되네", "계속", "주목", "팬"]
# Words that count as reactions beside REACTIONS; kinds of reactions by mood.
REACTION_WORDS = {"와아": "탄성·놀람", "와~": "탄성·놀람", "헐ㄷ": "충격·당황", "헐ㅋ": "충격·당황"}
GOOD_REACTIONS = ["감탄·대박", "기대 충족", "응원·격려", "웃음·재미", "웃음·가벼운", "탄성·놀람", "역전 장면"]
BAD_REACTIONS = ["안타까움·슬픔", "탄식·긴장"]
TENSE_REACTIONS = ["충격·당황", "동타 장면"]
# Roles of people who are no players.
NOT_PLAYERS = ["channel_host", "channel_participant"]
# What no name ends in, and compounds that look like names.
NO_NAME_ENDINGS = ["는", "들", "의", "을", "며", "하는", "가는", "오는", "있는", "없는", "되는", "치는", "시키는", "잘하는", "추격하는", "따라가는", "완성시키는", "좋아하는", "세우는", "넘기기", "해본", "하본", "어본"]
NO_NAMES = ["우승권", "선두권", "추격권", "장타", "선두", "넘길", "보인", "결국이", "보면이", "방송을", "클럽은", "위권을", "현두권", "명의"]
SUFFIXES = ["프로님", "선수님", "형님", "프로", "선수", "햄", "형", "님"]

# Lists that occur in the invented texts of the test tables, for queries whose results shouldn't be empty.
SAMPLE_SENTIMENT = {"positive": ["best", "great", "good"], "negative": ["bad", "idiot", "trash"], "surprise_excitement": ["whoa", "tion of", "the in"], "cheering_support": ["go", "support"], "criticism": ["error", "er the", "ent"]}
SAMPLE_CATEGORIES = {"dramatic": ["license"], "controversial": ["idiot", "moron", "trash"], "analytical": ["password", "| "], "funny": ["haha", "!!"], "critical": ["worst", "der "], "clutch_hype": ["best", "ble the", "great"], "emotional": ["les ", "clown"], "supportive": ["go", "con "]}
SAMPLE_EVENTS = {"the": "article", "and": "joint", "und": "joint", "of": "genitive", "in": "place", "la": "feminine"}
SAMPLE_SURE = ["genitive", "feminine"]
SAMPLE_CHEER = r"(of|the)\s+(the|a|and)"
SAMPLE_NOT_NOW = r"(tion|heit|der|was\s)"
SAMPLE_TITLED = r"([a-z]{2,5})(tion|ing|er|eur)"
SAMPLE_SUFFIXES = ["tion", "ing", "eur", "er"]
SAMPLE_FORMS = ["er", "ing"]
SAMPLE_BASE_FORMS = ["er", "ing", "eur"]
SAMPLE_ROSTER = ["xther", "onth", "nthe", "theon", "zont", "heon", "keit", "arer"]
SAMPLE_ALIASES = {"onther": "Onther A", "ather": "Ather B", "hea": "Heather", "onth": "Onth C", "anding": "Ander"}
SAMPLE_ACTS = {"act_1_opening": ["licensed", "the is"], "act_2_buildup": ["lead", "par "], "act_3_turning": ["password", "turn"], "act_4_climax": ["idiot", "best"], "act_5_closing": ["fin ", "end"]}
