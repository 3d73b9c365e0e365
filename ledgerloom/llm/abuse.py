"""Abusive, hateful and sexual language, scored by clauses.

Method: a weighted finite-state grammar.  A clause's disguises are undone (look-alike letters, digits for
letters, letters set apart, stretched or starred words, one slip in a long word).  A lexical transducer writes the
classes of its words (insults, scorn, targets, groups, bodily harm), transducers of patterns over them write insult,
threat, contempt for a group and sexual content with their weights, others mark negation, sober and reported
speech; all are composed into one machine (`automata.Machine`) that reads the clause once.  Isolated words never
score.  A document's score is 1 minus the product of (1 - weight) over its clauses.

Adding a language means adding to the fixed values below.  One narrow pass over the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.fold import fold, unmark
from ledgerloom.llm.automata import Machine

# Insulting nouns. All lists are in folded form: lower case, without accents.
INSULTS = (
    "idiot moron imbecile loser clown halfwit cretin dimwit nitwit numbskull fool dunce dolt simpleton lowlife scumbag scum bastard asshole arsehole dickhead prick twat wanker tosser cunt bitch whore slut skank retard"
    " shithead dipshit motherfucker fucker fuckwit douchebag jackass dumbass jerk creep crook liar thief coward weasel snake rat pig swine dog monkey parasite leech maggot cockroach vermin filth trash garbage rubbish worm louse pest freak psycho pervert sicko subhuman animal savage disease plague cancer waste swindler crybaby bonehead airhead blockhead meathead pinhead nobody failure disgrace joke troll nutjob lunatic scoundrel blowhard windbag muppet"
    " trottel vollidiot vollpfosten dummkopf drecksack drecksau arsch arschloch wichser hurensohn hure schlampe missgeburt penner versager schwein schweinehund abschaum ungeziefer pack gesindel spast depp blodmann affe untermensch ratte parasit sau miststuck dreckskerl"
    " connard connasse salaud salope batard enfoire encule cretin abruti ordure raclure crevure debile pute merde vermine racaille sous-homme sous-hommes sous-homme porc parasite bouffon tocard"
    " imbecil idiota gilipollas cabron cabrona pendejo puta puto mierda hijoputa basura escoria animal rata subhumano estupido capullo mamon zorra cerdo parasito asqueroso inutil payaso tarado"
    " stronzo coglione bastardo troia puttana merda idioti feccia cretino otario caralho babaca klootzak eikel sukkel hoer tering mongool"
).split()
# Nouns that insult only when bound to a target, as they also have a plain sense.
PLAIN_TOO = frozenset("rat pig swine dog monkey parasite leech maggot cockroach vermin filth trash garbage rubbish worm louse pest snake animal savage disease plague cancer waste failure joke clown creep prick bastard dumb pack affe sau ratte porc rata cerdo basura zorra puta weasel jerk nobody fool".split())
# Adjectives of contempt.
SCORN = "filthy stinking worthless pathetic useless gutless rotten lying disgusting stupid dumb braindead brainless spineless miserable dirty vile ugly fat greedy pitiful sickening slimy disgraceful ignorant retarded goddamn damn fucking bloody sick twisted cowardly despicable crooked erbarmlicher erbarmliche dreckiges dreckige verlogenen verlogene dummer dumme stinkende sale sales pauvre gros grosse putain puto maldito asqueroso asquerosos sucio sucia sucios rotting thick dim mindless clueless".split()
# Words for peoples and crowds.
CROWDS = "people settlers immigrants believers migrants refugees foreigners folk natives tribes women men gays lesbians blacks whites jews muslims christians arabs asians africans gypsies travellers minorities families family kind lot".split()

KINDS = ("insult", "threat", "hate", "sexual")
_VOWEL_SIGNS = str.maketrans("013457@$!|", "oieastasil")
_ALT_SIGNS = str.maketrans("013457@$!|", "oleastasll")


def _forms(words: list[str]) -> set[str]:
    out = set()
    for w in words:
        out |= {w, f"{w}s", f"{w}es", f"{w}en", f"{w}er"} if len(w) > 2 else {w}
        if w == "arschloch":
            out.add("arschlocher")
        if w.endswith("y"):
            out.add(f"{w[:-1]}ies")
        if w == "thief":
            out.add("thieves")
    return out


_INSULT = _forms(INSULTS)
_SCORN = set(SCORN)
# Words of sex that are looked for when disguised.
SEXUAL = "porn porno xxx nude nudes naked horny blowjob handjob tits boobs cock dick pussy cum orgasm milf hardcore threesome gangbang stripper strip undress moaned moaning erection jerk jerks wank wanking masturbate escort sexy sex nackte nackt geile geil ficken titten nue nues nu sexe baiser bite chatte desnuda desnudas desnudo calientes caliente follar sexo tetas polla coger".split()
_HARD = frozenset("fuck fucking fucked fuckers shit bullshit piss damn hell merde foutre mierda scheisse scheiss joder chinga carajo verrecken crever rot burn choke die kill dead disappear gueule fresse puta cojones pudrais".split())
_LEXICON = frozenset(_INSULT | _SCORN | set(SEXUAL) | _HARD | {"worthless", "subhuman", "parasites"})
_BY_SHAPE: dict[tuple[str, int], list[str]] = {}
for _w in sorted(_LEXICON):
    _BY_SHAPE.setdefault((_w[0], len(_w)), []).append(_w)


def _squeeze(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


_SQUEEZED = {_squeeze(w): w for w in sorted(_LEXICON, reverse=True)}
_LONG = [w for w in sorted(_LEXICON) if len(w) >= 7]
_SLIPS: dict[str, str] = {}
for _w in _LONG:
    for _k in range(1, len(_w) - 1):
        _SLIPS.setdefault(_w[:_k] + "?" + _w[_k + 1 :], _w)
for _w in sorted(w for w in _LEXICON if len(w) >= 6):
    for _k in range(1, len(_w) - 1):
        _SLIPS.setdefault(_w[:_k] + _w[_k + 1] + _w[_k] + _w[_k + 2 :], _w)

# Swear words that have no other sense.
_SWEARS = "fuck fucking fucked fucker fuckers shit bullshit merde foutre mierda scheisse scheiss chinga carajo gueule cojones".split()
_PURE = {w for w in _INSULT if w not in PLAIN_TOO and w.rstrip("s") not in PLAIN_TOO and w[:-2] not in PLAIN_TOO}
#: Words without a plain sense: one swap or doubling of inner letters is undone in short ones, too.
_STRONG = {w for w in _PURE | set(_SWEARS) if len(w) >= 4}
for _w in sorted(_STRONG):
    for _k in range(1, len(_w) - 2):
        _SLIPS.setdefault(_w[:_k] + _w[_k + 1] + _w[_k] + _w[_k + 2 :], _w)

_APART = re.compile(r"(?<![^\W_])[^\W_](?:([ .\-_*+/])[^\W_](?:\1[^\W_])+)(?![^\W_])")
_QUOTES = re.compile("[\"“”«»]|(?<![a-z0-9])'(?=[a-z])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$!#|'’\-]*[\w*#@$'’])?|[.,;:!?\"]")
_STARRED = re.compile(r"[a-z][*#]+[a-z]*\Z|[a-z]+[*#]+[a-z]+\Z")


@lru_cache(maxsize=1 << 17)
def _plain_word(t: str) -> str:
    """A token with its disguise undone, or the token itself."""
    if t in _LEXICON or t.isdigit():
        return t
    if "*" in t or "#" in t:
        if _STARRED.match(t):
            shape = re.compile(re.sub(r"[*#]", "[a-z]", t) + r"\Z")
            for w in _BY_SHAPE.get((t[0], len(t)), ()):
                if shape.match(w):
                    return w
        return t
    if any(c in "013457@$!|" for c in t) and any(c.isalpha() for c in t):
        for table in (_VOWEL_SIGNS, _ALT_SIGNS):
            w = t.translate(table)
            if w in _LEXICON:
                return w
            if _squeeze(w) in _SQUEEZED:
                return _SQUEEZED[_squeeze(w)]
        return t
    if re.search(r"(.)\1", t):
        s = _squeeze(t)
        if s in _STRONG:
            return s
        if s in _SQUEEZED and (re.search(r"(.)\1\1", t) or (len(t) >= 5 and _SQUEEZED[s] != s and len(t) != len(_SQUEEZED[s])) or len(t) >= 7):
            return _SQUEEZED[s]
    if len(t) >= 4:
        if t in _SLIPS:
            return _SLIPS[t]
        if len(t) >= 7:
            for k in range(1, len(t) - 1):
                if (w := _SLIPS.get(t[:k] + "?" + t[k + 1 :])) and w != t:
                    return w if len(w) >= 8 or w in _INSULT and len(w) >= 7 and t not in _SOUND else t
    return t


# Sound words one slip away from a listed one.
_SOUND = frozenset("parasitic failures animate animals lesions savings leeches wasting masters cleared failing coward cowards disease diseases".split())


_ELIDED = re.compile(r"\b(d|l|n|c|j|m|t|s|qu)'(?=[a-z]{2})")


def undisguise(clause: str) -> list[str]:
    """Words and marks of a clause, folded, with disguised words spelled out; "@group" stands for the name of a people."""
    folded = _QUOTES.sub(' " ', fold(clause).replace("’", "'"))
    folded = _APART.sub(lambda m: re.sub(r"[^\w]|_", "", m.group()), folded)
    if "'" in folded:
        folded = _ELIDED.sub(r"\1' ", folded)
    return ["@group" if t == "qqgroupqq" else _plain_word(t) for t in _TOKEN.findall(folded)]


# Classes of words that the patterns below name.
CLASSES = {
    "ins": _INSULT,
    "pure": _PURE,
    "adj": _SCORN,
    "crowd": CROWDS,
    "you": "you your yours yourself yourselves you're ur u ye du dich dir dein deine ihr euch tu toi te ton ta tes vous vos votre t eres ti tus os vosotros usted ustedes tuo tua sei voce jij".split(),
    "det": "a an the ein eine une un una les such one what".split(),
    "is": "are is was were sind ist sont son es sono sao zijn".split(),
    "fill": "all just nothing but only like no better than de la unos unas un una des eine ein a an the wie alle".split(),
    "vermin": "vermin animal animals subhuman subhumans sub-human parasite parasites filth scum trash garbage cockroaches rats disease plague cancer savages thieves criminals liars dirt pigs dogs monkeys ungeziefer abschaum untermenschen parasiten ratten tiere vermine racaille animaux sous-hommes escoria animales ratas basura plaga parasitos feccia bestie".split(),
    "harm": "kill hurt stab shoot beat punch smash break burn hang strangle slap hunt choke crush cut rip skin bash bury".split(),
    "body": "you your yours his her their face teeth bone bones skull throat head neck kneecaps house him them".split(),
    "killed": "beaten shot hanged hung whipped lynched stoned punched slapped killed burned burnt gassed raped stabbed drowned exterminated".split(),
    "die": "choke chokes burn burns die dies rot rots drown drowns disappear hang jump suffocate perish suffer suffers bleed vanish crash starve fall drop".split(),
    "they": "you they he she somebody someone".split(),
    "tellers": "said says called wrote quoted quotes alleged shouted yelled told described accused reads read".split(),
    "sober": (
        "policy policies harassment moderator moderators moderation removed remove banned training trained claim claims lawsuit court dismissed tribunal infection infections clinic screening patient patients treats treatment abusive reported report reports definition glossary"
        " so-called refer refers denote denotes survey study research researchers education prevention victim victims helpline slaughter terminal terminals file files compressor compressors mill mills cockpit livestock poultry farm"
    ).split(),
}

#: The pattern transducers: kind, weight, pattern. Order plays no part.
PATTERNS: list[tuple[str, float, str]] = [
    (kind, weight, pattern.strip())
    for kind, weight, patterns in [
        # insult bound to a target
        ("insult", 0.9, "<you> ~6 <pure> ; you|you're|du|ihr|tu|eres are|re|bist|seid|n'? es? qu'un|qu'|nothing_but|just|such|only? <det>? ~2 <ins> ; <adj> little|old|fat? <ins>"),
        ("insult", 0.85, "is|are|was|be|being|born|such|complete|total|utter|absolute|what a|an|the? complete|total|utter|absolute|bunch_of|pack_of|gang_of|bloody? <pure> ; pack|bunch|gang|band|horde|bande|pandilla|atajo|haufen|tas of|d'|d|de|von <adj>? <ins>"),
        ("insult", 0.85, "<pure> like|wie|comme|como you|him|her|them|du|dich|euch|ihr|toi|vous|tu|vosotros ; <pure> that_you_are ; the|that|this|these|those <adj>? <ins> who|that ~12 is|are|was? an|a|such? ~1 <ins>"),
        ("insult", 0.8, "^|,|;|:|!|. you|du|ihr|espece_de|espece_d'|pedazo_de|bande_de|so_ein|sale|pobre|maldito|malditos? <pure> !|.|,|$ ; you|you're are|re? so|really|just|too? braindead|brainless|worthless|pathetic|spineless|retarded|disgusting"),
        ("insult", 0.85, "espece|pedazo|bande|tas|hijo|hijos d'|de <ins> ; sale <ins> ; pareil|tels|todos_los|todas_las|unos|unas <pure>"),
        ("insult", 0.85, "waste_of skin|space|oxygen|air|breath ; oxygen_thief ; more_brains_than you|him|her|them ; as dim|dumb|stupid|thick|ugly as_you ; ashamed_of raising|having ; your_mother ~~8 ashamed ; crawl|crawled back under|into|to your|the|that|his|her|its ; braindead_or ; are_you braindead|retarded|brainless|mental|thick|stupid"),
        ("insult", 0.9, "fuck|screw|damn|curse you|your|off|yourself|them_all|the_lot ; piss|sod|bugger off ; go fuck|screw|kill|hang|drown|die ; get fucked|stuffed|lost_you ; suck_my ; eat_shit ; kiss_my ass|arse"),
        ("insult", 0.8, "bullshit|shit ~~8 you|your|they|rot ; lying|stupid|fat ~1 should|can rot|burn|die ; you_make_me sick|puke|vomit ; go_cry somewhere|elsewhere|to"),
        ("insult", 0.85, "shut_up ~~4 <ins> ; shut_your mouth|trap|face|hole ; shut_the fuck|hell up"),
        ("insult", 0.9, "halt|haltet die|deine|eure? fresse|klappe|schnauze|maul ; verpiss|verpisst|fick|fickt dich|euch ; leck|leckt mich ; ferme|fermez ta|vos|la|votre gueule|bouche ; ta_gueule ; va|allez te|vous faire foutre|enculer|voir ; nique_ta ; va_au_diable ; callate la_boca|el_hocico ; vete al|a_la carajo|mierda|diablo|infierno ; que_te jodan|den|follen ; me_cago_en ; chinga_tu ; vaffanculo|rot_op ; va|vai a_fare_in_culo|se_foder|tomar_no_cu"),
        # threat
        ("threat", 0.95, "i|we|i'll|we'll|i'm|somebody|someone|they will|would|am|are|gonna|going_to|should|ought_to|must|shall|want_to|want|swear_i_will* <harm> ~~7 <body> ; i|we|i'll|we'll|somebody|someone|they will|would|am|are|gonna|going_to|shall|want_to* come_for|spit_on|knock ~~7 <body> ; find out? where_you ; make_you pay|suffer|bleed|regret ; know_where_you live|sleep|work ; find_where_you_live ; break_every_bone ; watch_your_back"),
        ("threat", 0.95, "you|you'll will|are_going_to|gonna? die|bleed|suffer|regret|pay_for ; you_are_dead ; your family|kids|children will|are_next"),
        ("threat", 0.9, "deserves|deserve|deserved|ought|needs|need|should|want|wants to be|get <killed> ; deserves|deserve|deserved|ought|needs|need|should|want|wants to be thrown|put|strung out_of|off|under|down|up ; should be|get <killed> ; should be|get put_down|strung_up"),
        ("threat", 0.9, "hope|wish|pray|may|would|should|can|just|please|to|and|you|lot|them|all|:|,|must ~5 drop_dead|jump_off_a|jump_under|choke_on|choke_to|chokes_on|die_in_a|die_of|die_alone|die_slowly|drown|get_cancer|get_hit_by|kill_yourself|kill_themselves|end_yourself|end_your_life|hang_yourself|rot|go_to_hell ; drop_dead ; rot|burn in_hell ; go_to_hell ; die_in_a ditch|fire|hole|gutter ; kys ; kill|hang yourself ; jump_off_a bridge|cliff|roof|building"),
        ("threat", 0.9, "why don't|do_not|not|dont you just|all|finally* <die> ; <die> ,? all_of_you|the_lot_of_you|every_one_of_you|you_lot ; wish|hope|pray that? <they> would|all|will|both|just* <die> ; wish|hope|pray that? the ~2 would|all|will|both|just* <die>"),
        ("threat", 0.85, "nobody_would_miss_you ; do|make the_world_a favor|favour|better_place ~~8 disappear|die|vanish|gone|end|leave|jump ; not_be_allowed_to breathe|live|breed|vote|exist ; the_world would_be|is better_without you|them"),
        ("threat", 0.9, "schlag|schlage|hau|haue|brech|breche|bring|bringe|mach|mache|trete|tret|finde ich? dir|dich|euch|ihn|sie ; ich finde_heraus ; soll|sollt|sollen|sollst ~5 verrecken|krepieren|verrotten|sterben|brennen ; verreck|verrecke|krepier|krepiere ; allez|va|qu'ils|qu'il|qu'elle|qu'_ils|qu'_il|qu'_elle|puissent|puisses tous? crever|creve|crevent|mourir|bruler|pourrir ; je_vais_te tuer|casser|buter|crever|frapper|defoncer|retrouver|peter|demolir ; te_voy_a partir|matar|romper|reventar|encontrar|moler|dar ; os_voy_a partir|matar|romper|reventar ; ojala os|te|se|que? ~1 pudrais|pudras|mueras|muerais|mueran|pudran|revientes|ardais|ardas ; muerete ; ti ammazzo|spacco ; vou_te matar|quebrar"),
        ("threat", 0.85, "te|vous|dir|dich casser|peter|briser|polieren|einschlagen la|les|die|das gueule|dents|jambes|tete|fresse|zahne|knochen ; partir_la_cara ; zahne_aus ; la_gueule ~~6 casse|casser|peter|pete|eclate"),
        # contempt for a group
        ("hate", 0.95, "@group|<crowd> family|families|people? <is> <fill>* <adj>? <vermin>"),
        ("hate", 0.9, "@group ~~18 vermin|subhuman|subhumans|parasite|parasites|filth|filthy|scum|plague|disease|breed_like|driven_out|drive_out|barred_from|deport|thieves|liars|do_not_belong|don't_belong|does_not_belong|animals|infest|sous-hommes|vermine|ungeziefer|untermenschen|animales|dreckiges_pack|gesindel|nicht_erst|vertrieben|chasse|out_of_here|ruin|crawled|invader|invaders|inferior|degenerate|degenerates"),
        ("hate", 0.9, "they|they're are|re|all* vermin|subhuman|animals|parasites|filth|scum|a_plague|a_disease|a_cancer|savages|cockroaches ; son|sont|sind unos|des|de_la|alle? animales|animaux|vermine|ungeziefer|tiere|abschaum|ratas|escoria"),
        ("hate", 0.9, "breed|breeds like rats|rabbits|flies|vermin|cockroaches ; by_blood ; their|that|his|her kind is|are|a|not|must|should|can|of ; driven_out_of ~~20 vermin ; ungeziefer|vermin|vermine|racaille|abschaum|escoria ~~8 vertrieben|driven_out|chasses|chasse|expulsados ; decent folk|people|families|citizens"),
        ("hate", 0.9, "deport|expel|gas|sterilise|sterilize|exterminate|wipe_out|get_rid_of|round_up|throw_out|kick_out|lock_up every|all|each|these|those|the|them ~~6 @group|<crowd>|last_one"),
        ("hate", 0.9, "only_good ~1 @group|<crowd>? is|are|was ; god_made_a_mistake ; back to? where they|you|he|she came|crawled ; crawled_out from|of"),
        ("hate", 0.85, "was|were|used_to_be clean|safe|decent|quiet|civilised|civilized|nice|fine|better|peaceful until|before|till the|all|those|these* @group ; was|were|used_to_be clean|safe|decent|quiet|civilised|civilized|nice|fine|better|peaceful until|before|till ~2 people|settlers|immigrants|believers|migrants|refugees|folk"),
        ("hate", 0.85, "never|don't|cannot|can't|do_not trust a|an|any? ~4 @group|their_kind|those_people ; filthy|dirty|stinking|rotten|dreckiges|sale lot|pack|bunch|breed|race|people|folk|swine ; for_hiring_@group ; because|as|since @group made|built|own|run|touched|work"),
        ("hate", 0.85, "nothing|all|typical|just_like|these|those|no|keep|send|hate|like|solche_wie|con|les|die|des|los|las the|all|those|die? @group ~~16 expect|esperar|reinlassen|lazy|steal|stupid|back|away|dreckig+|go_home|cheat|smell|stink|trouble|unclean|not_welcome|liars|thieves|never"),
        # sexual
        ("sexual", 0.95, "blowjob|blowjobs|handjob|handjobs|gangbang|gangbangs|milf|milfs|cumshot|cumshots|threesome|threesomes|creampie|creampies ; porn|porno|xxx tape|video|clip|clips|movie|pics|site|star|party|full|film ; full|free|hot|watch|uncensored|leaked|hardcore|click ~~8 porn|porno|xxx|nude|nudes"),
        ("sexual", 0.9, "hot|horny|sexy|naked|nude|young|wild|dirty|bored|lonely|wet|kinky|busty|nasty|college ~1 girl|girls|women|woman|single|singles|babe|babes|teen|teens|wives|wife|ladies|milfs|boy|boys|men|chick|chicks|model|models|slut|sluts|housewife|housewives|nurse|nurses ~~16 sex|naked|undress|live|fun|tonight|strip|near|free|discreet|waiting|chat|cam|clips|xxx|fuck|meet|meets|seek|seeks|want|wants"),
        ("sexual", 0.9, "want|wants|wanting|need|needs|have|having|like|offer|offers|pay_for|free|hot|quieren|will|wollen|suche|ohne ~1 sex|sexo tonight|now|with|chat|ohne|esta_noche|on|in_the|all|date ; sex tonight|chat|cam|tape|ohne|party|toy_for|toys_for ; sex_with me|you|her|him ; quieren_sexo"),
        ("sexual", 0.9, "send me? your? nude|nudes|naked|pics_of_your ; great|nice|huge|big|hot|sexy|perfect|her|his|firm tits|boobs|ass|arse|rack|cock|dick|butt|cleavage|legs ; bang|fuck|ride|screw|shag|do|bend|lick|suck|undress|spank|grope her|him|me|you|them ~3 on_the|all_night|over|hard|in_the|from_behind|right_now|desk|until|so ; i_would bang|shag|bend|do|tap|ride|smash her|him|that|you"),
        ("sexual", 0.9, "jerk|jerks|jerking|jerked|wank|wanks|wanking|masturbat+|fingering|touch_himself|touch_herself|touch_myself|touches_himself|touches_herself|touching_himself|touching_herself|touching_myself off? ~~6 off|during|to|over|in|while|at ; moan|moans|moaned|moaning so|very* loud|hard|in ; get|gets|getting hard|wet|horny|turned_on|erection|an_erection every_time|when|for|thinking|just|from|watching ; bend|bends over ~~4 $ ; stare|stares|staring at ~3 tits|arse|ass|boobs|legs|cleavage|butt|breasts"),
        ("sexual", 0.9, "strip and|for|naked|off|down ~2 me|ride|you|us|dance|all ; ride|riding|take|taking me ~~4 night|hard|baby ; escort|escorts ~~10 positions|cash|hour|night|service|services|discreet|outcall|incall|available ; dirty fun|talk|pics|weekend ; discreet|nsa|no_strings ~~6 sex|fun|men|women|meet|affair ; undress|undresses|undressing live|for|on|slowly|you ; wet pussy|for_you ; my cock|dick|pussy ; make_love_to_me ; in_bed_with me|you|us"),
        ("sexual", 0.9, "geile|heisse|nackte|nackt|scharfe|versaute ~1 frauen|madchen|girls|weiber|singles|frau|studentinnen|schlampen|hausfrauen|manner ; fille|filles|femme|femmes|meuf|meufs ~1 nue|nues|chaude|chaudes|coquine|coquines|sexy ; veulent|veut|envie_de baiser|coucher|du_sexe|te_sucer ; chica|chicas|mujeres|chavas ~1 desnuda|desnudas|caliente|calientes|cachonda|cachondas|guarra|guarras ; sex_ohne ; ohne_grenzen ~~4 $ ; plan_cul ; ragazze nude|calde ; mulheres nuas|peladas"),
        # what a clause says about itself: read by `clause_weight`
        ("negated", 1.0, "not|never|no|isn't|aren't|wasn't|nobody_called|nobody_said|kein|keine|nicht|pas|jamais|nunca|ningun be? called? ~1 a|an|the|such|ein|eine|une|un? ~1 <ins>"),
        ("direct", 1.0, "<you>"),
        ("sober", 1.0, "<sober> ; discriminat+ ; alleg+ ; complain+ ; prohibit+ ; forbid+ ; the word|term|phrase ; disease|pest control ; control_contract ; hate_speech ; content_standards ; code_of_conduct ; support_line ; short_selling ; kill_switch"),
        ("reported", 1.0, '<tellers> ~~10 "'),
    ]
    for pattern in patterns.split(" ; ")
]
MACHINE = Machine(PATTERNS, CLASSES)
#: How what a clause says about itself weighs on what it does: mark, factor, kinds.
DAMPING = (("negated", 0.3, ("insult",)), ("sober", 0.35, ("insult", "threat", "hate", "sexual")), ("reported", 0.5, ("insult", "threat", "hate")))
_CLAUSE = re.compile(r"(?<=[.!?])[\"'”)\]]*\s+(?=\S)|[\r\n]+|(?<=[:;])\s+(?=[A-ZÀ-Þ])|</?[a-zA-Z][^>]{0,80}>")
# Nouns that a name in front makes a people; endings of names of peoples; words that stand in front of one without being a name.
_FOLK = "people settlers immigrants believers migrants refugees folk natives nomads travellers pilgrims tribe tribes tribesmen newcomers exiles workers".split()
_ENDINGS = "ian ians ans ari folk ite ites ish ards lings".split()
_NO_NAME = "The All Every Typical Keep Send Les Die Des Con Solche Jamais God Never Only No We I Our In Of At And These Those Some Many Most Few Other Such More Local Young Old".split()
_CAPITAL_GROUP = re.compile(rf"\b(?!(?:{'|'.join(_NO_NAME)})\b)(?:[A-Z][a-z]+ (?:{'|'.join(_FOLK)})\b|[A-Z][a-z]+(?:{'|'.join(_ENDINGS)})\b(?! [A-Z]))")


#: Two capitalised words or more in a row: a name.
_NAME = re.compile(r"\b[A-Z][a-z]+(?:[ -][A-Z][a-z]+)+\b")


def clauses(text: str | None) -> list[str]:
    """The text cut at ends of sentences, lines and marks."""
    if not text:
        return []
    return [c for c in _CLAUSE.split(_WRAP.sub(" ", text)) if c and not c.isspace()]


_WRAP = re.compile(r"(?<![.!?:])[ \t]*\r?\n[ \t]*(?=[a-zà-þ(])")


def clause_weight(clause: str) -> tuple[float, str | None]:
    """(weight, kind) of a clause; (0.0, None) for a clean one.

    The kind of the greatest weight counts, damped by what the clause says about itself: that it negates, or is sober or reported
    speech. Sober words do not excuse what is said to somebody's face, and words inside names do not count as sober.
    """
    marked = _CAPITAL_GROUP.sub(" qqgroupqq ", unmark(clause))
    found = MACHINE.run(undisguise(marked))
    kinds = [(w, k) for k, w in found.items() if k in KINDS]
    if not kinds:
        return 0.0, None
    weight, kind = max(kinds, key=lambda x: (x[0], -KINDS.index(x[1])))
    for mark, factor, own in DAMPING:
        if mark not in found or kind not in own or mark == "sober" and ("direct" in found and kind in ("insult", "threat") or "sober" not in MACHINE.run(undisguise(_NAME.sub(" ", marked)))):
            continue
        weight *= factor
    return weight, kind


def score(text: str | None) -> tuple[float, str | None]:
    """(score, kind of the heaviest clause) of a text; (0.0, None) for None, blank and clean texts."""
    rest, most, kind = 1.0, 0.0, None
    for c in clauses(unmark(text) if text and "&" in text else text):
        w, k = clause_weight(c)
        rest *= 1 - w
        if w > most:
            most, kind = w, k
    return round(1 - rest, 6), kind


def score_texts(df: DataFrame, key: str, text: str, source: str | None = None) -> DataFrame:
    """(key, source if given, score double, kind string) for every row of `df`, repeated rows included.

    Null, empty and blank texts score 0 with a null kind; long texts are read whole; other columns play no part.
    """
    cols = [F.col(key).alias("key"), *([F.col(source).alias("source")] if source else []), F.col(text).alias("text")]
    rows = df.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [score(t) for t in b["text"]]
            yield b.drop(columns="text").assign(score=[s for s, _ in out], kind=[k for _, k in out])

    out = rows.mapInPandas(run, f"{schema}, score double, kind string").withColumnRenamed("key", key)
    return out.withColumnRenamed("source", source) if source else out


#: From this score on a document counts as abusive: one undamped clause is enough, damped ones are not.
THRESHOLD = 0.6


def rates(scored: DataFrame, source: str) -> DataFrame:
    """One row per source (null is one too): source, documents, abusive, rate, by kind insult, threat, hate, sexual."""
    hit = F.col("score") >= THRESHOLD
    kinds = [F.count_if(hit & (F.col("kind") == k)).alias(k) for k in ("insult", "threat", "hate", "sexual")]
    return scored.groupBy(source).agg(F.count("*").alias("documents"), F.count_if(hit).alias("abusive"), F.round(F.avg(hit.cast("double")), 6).alias("rate"), *kinds)
