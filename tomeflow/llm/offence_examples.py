"""Training data of problem 9: fixed values.

``LEXICON``: class -> words (a trailing * stands for any ending) that an offence may be made
of, and that ordinary texts use as well; it tells no case by itself.  ``OFFENSIVE`` and
``BENIGN`` are labelled sentences, written for this module.  {G} stands for a group of people
(``GROUPS``, ``NEUTRAL_GROUPS``), {I} for an insult (``INSULTS``).  The model is to recognise
such text in order to take it out.
"""

from __future__ import annotations

LEXICON = {
    "insult": "idiot* dolt* jerk* moron* imbecil* imbécil* dumbass* asshole* loser* scum* bastard* dimwit* halfwit* numbskull* crap clown* fool fools brainless brain-dead worthless pathetic dumb stupid* "
    "arschloch* vollidiot* trottel* drecksack* missgeburt* depp* blödmann* dummkopf* schwachkopf* hohlkopf* wichser* blöd blöde* dumm dumme* "
    "connard* abruti* crétin* débile* ordure imbécile* salaud* salope* minable* bouffon* bête stupide* con conne "
    "estúpid* gilipollas cabrón* cabron* payas* basura idiotas inútil* tonto tonta tarado* pendejo* "
    "burro palhaço* lixo otário* parvo* babaca* "
    "غبي غبية أغبى أغبياء أحمق حمقاء حثالة حمار تافه حقير حقيرة سافل وغد ساقط قذر جاهل أبله معتوه "
    "احمق کودن آشغال بی‌شعور بیشعور الاغ نادان ابله عوضی",
    "vulgar": "fuck* shit* bullshit piss* stfu  dick dickhead* damn screw crap arse scheiß* scheiss* verpiss* verreck* fresse kacke drecks* merde* putain pute* foutre chier dégage* mierda joder puto puta coño hostia carajo "
    "merda caralho porra foda* puta fresse verdammt* خرا ابن زبالة قمامة كلب لعنة تبا سحقا گوه لعنتی کثافت لجن garbage trash filthy",
    "hush": "shut mouth halt klappe maul ferme gueule tais cállate calla cala boca اخرس اسكت اصمت خفه دهنت ببند",
    "harm": "kill* spit spuck* crache* escup* أبصق بصق smash* punch* beat beaten beating choke* strangle* stab* slap* murder* die dead hang hanged shoot regret break bones teeth jaw burn "
    "umbring* schlag* schläg* verprügel* verprüg* töte* zähne knochen erstech* stirb krepier* abstech* prügel* "
    "tuer crever crève frapper casser étrangler gifle* coups dents égorg* tabasser romper* rompo matar* mato paliza golpe* muér* mueras mueran estrangul* dientes "
    "partir-te matar-te surra morras morre espanc* dentes أقتل سأقتل أكسر سأكسر أحطم سأحطم أضرب سأضرب أضربك الضرب تموت موت أسنانك عظامك أذبح سأذبح رقبتك كرامتك وجهك "
    "بکشم می‌کشم خرد می‌شکنم بمیری بمیر کتک دندان",
    "vermin": "vermin rats rat pigs cockroach* lice leech* parasit* plague* cancer disease* subhuman* animals beasts filth dirty stink* stinks stinking smell breed* inferior savages "
    "ungeziefer ratten schweine kakerlaken parasit* seuche* pest krankheit* untermensch* tiere dreckig* stinken gestank minderwertig* schmarotzer* brut "
    "parasites vermine cafards rats peste maladie sous-hommes animaux sales puent puer inférieur* cochons sangsues "
    "plaga* ratas cerdos cucarachas parásitos peste enfermedad animales sucios apestan inferior* bestias sanguijuelas "
    "praga* ratos porcos baratas parasitas doença animais sujos fedem cheiram bichos "
    "حشرات جرذان خنازير صراصير طفيليات وباء طاعون مرض حيوانات قذرون قذرة نجس أنجاس دمهم سرطان بهائم "
    "انگل موش‌ها خوک‌ها سوسک‌ها طاعون بیماری حیوان کثیف حشره آفت",
    "crime": "thieves liars criminals steal cheat* cheats deceit* lie traitors rapists murderers crooks diebe lügner verbrecher betrug betrüger stehlen lügen verräter "
    "voleurs menteurs criminels voler trichent mentir traîtres escrocs ladrones mentirosos criminales roban mienten engaño traidores "
    "ladrões mentirosos criminosos roubam mentem traidores لصوص كذابون كذابين مجرمون خونة غدر الغدر يسرقون يكذبون غشاشون خائنون دزد دروغگو جنایتکار خائن فریب",
    "expel": "expel* burn deport* exterminat* banish* wipe* wiped eradicate* gas lock locked chains drive driven throw thrown kick rid ausrotten rauswerfen vertreib* verjag* jagen gejagt einsperren abschieben ausweisen raus vergasen verbann* "
    "chasser expulser exterminer enfermer éliminer bannir dehors renvoyer echar expulsar exterminar encerrar eliminar fuera deportar "
    "expulsar exterminar prender fora deportar طرد طردهم نطرد إبادة إبادتهم سجن ترحيل التخلص اطردوا نتخلص حبس بیرون اخراج نابود زندانی راند",
    "deny": "deserve deserves trust allowed ban banned rights hate hates hated ashamed despise detest* believe verdien* hasse hasst hassen verabscheu* verbiet* verboten trau* traut rechte glaubt "
    "méritent mérite hais déteste interdire interdis* confiance droits croyez merecen merece odio detesto prohib* confi* derechos crean "
    "merecem merece odeio detesto proib* confi* direitos يستحقون يستحق أكره نكره تثقوا تثق تسمحوا تسمح امنعوا منع ممنوع حقوق تصدقوا متنفرم متنفریم اعتماد حق ندارند",
    "never": "never nobody nothing no niemals nie niemand nichts kein* jamais personne aucun* nunca jamás nadie nada ninguém لا أبدا أبدًا لن هرگز نباید هیچ",
    "without": "without ohne sans sin sem بدون دون",
    "cleaner": "cleaner better nicer purer safer sauberer besser reiner schöner propre mieux meilleur* limpio mejor puro limpo melhor أنظف أفضل أجمل أنقى پاک‌تر بهتر تمیزتر",
    "sex": "porn* xxx milf* blowjob* anal cock cocks pussy tits boobs cum horny      stripper* panties orgasm* moan* moaned erotic* escort* webcam lick* licked undress* undressed suck* sucked     lingerie "
    "porno* fick* fickte gefickt titten schwanz muschi  geil* sexchat* stripperin höschen stöhn* ausgezogen blasen   slip unterwäsche erotik* "
    "pornographi* baiser baisé baisa nichons bite chatte      strip-teaseuse* culotte gémi* suce* sucé  érotique* lingerie déshabill* chaudes chaude "
    "pornográf* follar folló follaron tetas polla coño    bragas gimió chup*  erótic* calientes lencería "
    "foder fodeu mamas pau cona     cuecas gemeu chupou despiu* despir quentes "
    "إباحية إباحي إباحيات جنس   جماع     ثدي ثدييها نهديها لعق مثيرات مثيرة شهوة قضيب فرج  ملابسها عريان نكح تعرت خلعت راقصة "
    "پورن  سکسی   پستان شهوت هوس لباسش داغ ",
    "body": "naked nude nudes sexual* breast breasts penis vagina nackt* sexuell* brüste nue nues nu sexuel* seins desnud* pechos nua nuas sexuais جنسية جنسي عارية عاريات عاري عار برهنه لخت جنسی sex sexo sexe سکس الجنس bitch",
    "advert": "adults adult call click tonight watch order chat chats live clip video videos pics photos meet subscribe uncensored free erwachsene ruf klick heute anschauen bilder fotos treffen live unzensiert kostenlos video "
    "adultes appelle* appelez clique* soir regarde* photos rencontre* direct vidéo nuit adultos llama* noche mira* fotos vídeo vivo encuentro* gratis adultos liga noite vê veja vivo للكبار للبالغين اتصل اضغط شاهد صور فيديو الليلة أفلام محادثات مقاطع بزرگسالان زنگ کلیک ببین عکس عکس‌های فیلم امشب",
    "intimate": "wife husband couple girlfriend boyfriend lover bed hotel night sofa body women woman girls wives ehefrau ehemann paar freundin bett hotel nacht frau frauen körper hausfrauen épouse mari couple amante lit hôtel femme femmes corps filles esposa esposo pareja novia cama hotel mujer mujeres cuerpo chicas "
    "marido casal namorada cama mulher mulheres corpo زوجته زوجها الزوجة الزوج عشيقته فندق سرير الرجل جسد جسدها نساء فتيات الرجال زن زنان شوهر همسر تخت هتل بدن",
    "you": "you your yours u ur yourself du dir dich dein* euch ihr tu te toi ton ta tes vous votre ti tú tus eres usted vosotros teu tua teus és você seu أنت أنتم أنتِ لك عليك إليك يا مثلك وجهك تو شما خودت",
    "self": "i me my myself mine ich mir mich mein* je moi mon ma mes yo mí mi mis me eu mim meu minha مني أنا نفسي نسيت كنت من من‌ خودم",
    "they": "they them their these those sie ihnen ihr* diese ils elles leur leurs eux ces ellos ellas sus estos esas eles elas deles هم هؤلاء لهم منهم دمهم طبعهم آنها آنان این‌ها",
    "school": "help aide ayuda ajuda hilfe مساعدة کمک units unités unidades einheiten page dog bird birds fish heart bone egg pups puppies herd sheep horse hen wolf bees hund vogel fisch herz chien oiseau poisson cœur perro pájaro pez corazón cão pássaro peixe coração طائر سمكة قلب حصان پرنده ماهی قلب lesson unit chapter teacher explains explain text poster history story fable farm plant plants cell cells virus pollen seeds seed animal biology chromosomes reproduction division puberty germs species host antibodies river law unjust wrong rights vote museum experiment "
    "lektion einheit kapitel text plakat erklärt geschichte fabel bauernhof pflanze* zelle* virus pollen samen biologie chromosomen fortpflanzung pubertät unrecht gesetz museum "
    "leçon unité chapitre texte affiche explique histoire fable ferme plante* cellule* virus pollen graines biologie chromosomes reproduction puberté injuste loi musée "
    "lección unidad capítulo texto cartel explica historia fábula granja planta* célula* virus polen semillas biología cromosomas reproducción pubertad injusto ley museo "
    "lição unidade capítulo texto cartaz explica história fábula quinta planta* célula* vírus pólen sementes biologia cromossomas reprodução injusto lei "
    "درس الدرس وحدة الوحدة فصل الفصل نص النص ملصق قصة القصة يشرح تشرح مزرعة نبات النبات خلية الخلية فيروس لقاح اللقاح بذور البذور أحياء كروموسومات الكروموسومات تكاثر التكاثر ظلم ظلما ظلمًا قانون متحف جراثيم "
    "درس فصل متن پوستر داستان توضیح گیاه گیاهان یاخته سلول ویروس گرده دانه تولید مثل زیست نادرست قانون موزه",
}

INSULTS = {
    "en": ("moron", "complete imbecile", "asshole", "worthless clown", "dumb bastard", "stinking pig"),
    "de": ("Trottel", "Drecksack", "Arschloch", "Schwachkopf", "dreckiges Schwein"),
    "fr": ("abruti", "connard", "crétin", "pauvre con", "sale porc"),
    "es": ("gilipollas", "imbécil", "cabrón", "payaso", "cerdo asqueroso"),
    "pt": ("imbecil", "palhaço", "otário", "porco sujo"),
    "ar": ("غبي", "أحمق", "حمار", "حقير", "خنزير قذر"),
    "fa": ("احمق", "کودن", "الاغ", "خوک کثیف"),
}
GROUPS = {
    "en": ("women", "immigrants", "the disabled", "old people", "refugees", "foreigners", "the people of the south", "the believers of that church"),
    "de": ("Frauen", "Einwanderer", "die Behinderten", "die Alten", "die Ausländer", "die Leute aus dem Süden"),
    "fr": ("les femmes", "les immigrés", "les handicapés", "les vieux", "les étrangers", "les gens du sud"),
    "es": ("las mujeres", "los inmigrantes", "los discapacitados", "los viejos", "los extranjeros", "la gente del sur"),
    "pt": ("as mulheres", "os imigrantes", "os deficientes", "os velhos", "os estrangeiros"),
    "ar": ("النساء", "المهاجرين", "المعاقين", "العجائز", "الأجانب", "أهل الجنوب"),
    "fa": ("زنان", "مهاجران", "معلولان", "پیرها", "خارجی‌ها"),
}
NEUTRAL_GROUPS = {
    "en": ("bakers", "the students", "my neighbours"),
    "de": ("die Bäcker", "die Schüler"),
    "fr": ("les boulangers", "les élèves"),
    "es": ("los panaderos", "los alumnos"),
    "pt": ("os padeiros", "os alunos"),
    "ar": ("الخبازين", "الطلاب"),
    "fa": ("نانواها", "شاگردان"),
}

OFFENSIVE = {
    "en": {
        "abusive": (
            "Open your mouth once more and you will regret it, {I}.", "How can anybody be as thick as you, {I}?", "I swear I will punch you until you cry.", "Crawl back under your stone, {I}.", "You make me sick, whatever you write is trash.",
            "Drop dead, {I}.", "My dog has more brains than a {I} like you.", "Be ashamed of yourself, {I}, and go away.", "That summary is bullshit and its author is a {I}.", "Wait until I catch you alone, I will break your bones.",
            "Screw you, {I}, and all your friends.", "These lines must have been typed by a {I}.", "They laugh at you because you are a {I}.", "What kind of {I} cannot solve this?", "Shut your filthy mouth.", "Piss off, your ideas are shit.", "I am going to strangle you, {I}.", "A {I} has drawn this picture, hit him.",
        ),
        "hateful": (
            "Throw {G} into the sea, every one of them.", "Life would be nicer without {G} around.", "{G} should be chained up, not heard.", "There is nothing good about {G}, they only steal and lie.", "Our town was fine until {G} came and brought their filth.", "I would never sit next to {G}, they smell like pigs.", "{G} have smaller brains and should not be allowed to study.",
            "Send {G} back where they came from, they are a cancer.", "Somebody should shoot {G} before there are more of them.", "{G} are no humans, they are cockroaches.", "Never give {G} a job, they are criminals by birth.", "The best {G} could do is to disappear from the earth.", "Do not believe a word of {G}, deceit runs in their veins.",
            "{G} must be deported, we are better off without them.", "I hate {G} and everything that they stand for.", "Ban {G} from our streets, they carry diseases.", "Lock {G} away, they breed like lice.", "Why do {G} still have rights, they are beasts.", "{G} are thieves, get rid of every one.",
        ),
        "sexual": (
            "Click here for nude webcam girls who moan all night.", "Lonely housewives are horny and want your cock, chat with them.", "She took off her panties and he licked her body in bed.", "Free porn videos, only for adults.", "They had sex on the kitchen table and she moaned loudly.", "The dancer showed her naked tits to the drunk men.",
            "Buy erotic pictures of naked women here.", "He sucked on her breasts while she undressed him.", "My wife and her lover fucked in the hotel.", "Hot escort girls for tonight, call this number.",
        ),
    },
    "de": {
        "abusive": ("Noch ein Wort und ich breche dir die Knochen, {I}.", "Wie kann man so dumm sein wie du, {I}?", "Mach die Klappe zu, {I}.", "Du stinkst und alle lachen über dich, {I}.", "Ein {I} hat diese Zeilen getippt, schlagt ihn.", "Was für ein {I} schafft das nicht?", "Deine Ideen sind Scheiße.", "Ich prügle dich durch, {I}.", "Stirb endlich, {I}.", "Hau ab, du bist nur Dreck, {I}."),
        "hateful": ("Werft {G} ins Meer, einen nach dem anderen.", "Das Leben wäre schöner ohne {G}.", "Haltet {G} von unseren Kindern fern, sie sind eine Krankheit.", "{G} bringen nur Dreck und Krankheiten.", "Niemand soll {G} Arbeit geben, sie sind Verbrecher von Geburt.", "{G} haben keine Rechte verdient, sie sind Kakerlaken.", "Schickt {G} zurück, sie sind eine Pest.", "Ich hasse {G}, sie lügen und stehlen.", "Verbietet {G} die Straße, diese Schweine.", "Glaubt {G} nie ein Wort, sie sind geborene Betrüger.", "Ohne {G} ginge es uns besser, man muss sie vertreiben."),
        "sexual": ("Klick hier für nackte Mädchen vor der Webcam.", "Einsame Hausfrauen sind geil und wollen deinen Schwanz.", "Sie zog das Höschen aus und er leckte ihren Körper im Bett.", "Gratis Pornos, ab achtzehn.", "Sie hatten Sex auf dem Tisch und sie stöhnte laut.", "Die Tänzerin zeigte den Männern ihre nackten Titten.", "Erotische Bilder von nackten Frauen kaufen."),
    },
    "fr": {
        "abusive": ("Encore un mot et je te casse les os, {I}.", "Comment peut-on être aussi bête que toi, {I} ?", "Ta gueule, {I}.", "Tu pues et tout le monde rit de toi, {I}.", "Ces lignes ont été tapées par un {I}, frappez-le.", "Quel {I} ne sait pas faire ça ?", "Tes idées, c'est de la merde.", "Je vais t'étrangler, {I}.", "Crève enfin, {I}.", "Casse-toi, tu n'es qu'une ordure."),
        "hateful": ("Jetez {G} à la mer, tous sans exception.", "La vie serait plus belle et meilleure sans {G}.", "{G} n'apportent que la saleté et la maladie.", "Personne ne devrait embaucher {G}, ce sont des criminels de naissance.", "{G} ne méritent aucun droit, ce sont des cafards.", "Renvoyez {G}, ils sont une peste.", "Je déteste {G}, ils mentent et volent.", "Interdisons nos rues à {G}, ces cochons.", "Sans {G} on serait mieux, il faut les expulser.", "Ne croyez jamais {G}, ils trichent tous."),
        "sexual": ("Clique ici pour des filles nues en webcam.", "Des épouses seules veulent ta bite ce soir.", "Elle a ôté sa culotte et il a léché son corps au lit.", "Porno gratuit, pour adultes.", "Ils ont fait du sexe sur la table et elle gémissait.", "La danseuse montrait ses nichons aux hommes.", "Achetez des images érotiques de femmes nues."),
    },
    "es": {
        "abusive": ("Una palabra más y te rompo los huesos, {I}.", "¿Cómo se puede ser tan tonto como tú, {I}?", "Cierra la boca, {I}.", "Apestas y todos se ríen de ti, {I}.", "Estas líneas las tecleó un {I}, péguenle.", "¿Qué {I} no sabe hacer esto?", "Tus ideas son una mierda.", "Te voy a estrangular, {I}.", "Muérete de una vez, {I}.", "Vete, no eres más que basura."),
        "hateful": ("Tiren a {G} al mar, a todos.", "La vida sería mejor sin {G}.", "{G} solo traen suciedad y enfermedad.", "Nadie debería dar trabajo a {G}, son criminales de nacimiento.", "{G} no merecen derechos, son cucarachas.", "Manden de vuelta a {G}, son una peste.", "Detesto a {G}, mienten y roban.", "Prohíban la calle a {G}, esos cerdos.", "Sin {G} estaríamos mejor, hay que expulsarlos.", "No crean nunca a {G}, todos engañan."),
        "sexual": ("Haz clic aquí para ver chicas desnudas en la webcam.", "Esposas solas quieren tu polla esta noche.", "Ella se quitó las bragas y él le lamió el cuerpo en la cama.", "Porno gratis, para adultos.", "Tuvieron sexo en la mesa y ella gemía.", "La bailarina enseñaba las tetas a los hombres.", "Compra imágenes eróticas de mujeres desnudas."),
    },
    "pt": {
        "abusive": ("Mais uma palavra e parto-te os dentes, {I}.", "Como se pode ser tão burro como tu, {I}?", "Fecha a boca, {I}.", "Que {I} não sabe fazer isto?", "As tuas ideias são merda.", "Morre de uma vez, {I}.", "Estas linhas foram feitas por um {I}, batam-lhe."),
        "hateful": ("Deitem {G} ao mar, todos.", "A vida seria melhor sem {G}.", "{G} só trazem sujidade e doença.", "{G} não merecem direitos, são baratas.", "Mandem {G} embora, são uma peste.", "Detesto {G}, mentem e roubam.", "Sem {G} estaríamos melhor, é preciso expulsar todos."),
        "sexual": ("Clica aqui para ver raparigas nuas na webcam.", "Ela tirou as cuecas e ele lambeu-lhe o corpo na cama.", "Pornografia grátis, para adultos.", "Fizeram sexo na mesa e ela gemia.", "A dançarina mostrava as mamas aos homens."),
    },
    "ar": {
        "abusive": ("كلمة أخرى وسأكسر عظامك يا {I}.", "كيف يكون إنسان غبيًا مثلك يا {I}؟", "أغلق فمك القذر يا {I}.", "الجميع يضحك عليك لأنك {I}.", "كتب هذه السطور {I} فاضربوه.", "أي {I} لا يعرف هذا؟", "أفكارك زبالة.", "سأخنقك وأقتلك يا {I}.", "ليتك تموت يا {I}.", "ابتعد فأنت حثالة.", "سأضربك حتى تبكي."),
        "hateful": ("ارموا {G} في البحر جميعًا.", "الحياة أجمل بدون {G}.", "لا يجلب {G} إلا القذارة والمرض.", "لا تعطوا {G} عملًا فهم مجرمون بالولادة.", "{G} صراصير ولا حقوق لهم.", "أعيدوا {G} من حيث جاؤوا فهم وباء.", "أكره {G} لأنهم يكذبون ويسرقون.", "امنعوا {G} من شوارعنا فهم خنازير.", "نحن أفضل بدون {G} ويجب ترحيلهم.", "لا تصدقوا {G} فالخيانة في دمهم.", "يجب التخلص من {G} لأنهم لصوص."),
        "sexual": ("اضغط هنا لمشاهدة فتيات عاريات.", "نزعت ملابسها ولعق جسدها في السرير.", "مقاطع إباحية مجانية للكبار.", "مارسا الجنس على الطاولة وهي تتأوه.", "كشفت الراقصة ثدييها العاريين للرجال.", "نساء وحيدات يردن الجنس معك، اتصل.", "صور مثيرة لنساء عاريات للبيع."),
    },
    "fa": {
        "abusive": ("یک کلمه دیگر و دندانت را خرد می‌کنم {I}.", "چطور کسی مثل تو این‌قدر {I} است؟", "دهنت را ببند {I}.", "این خط‌ها را یک {I} نوشته است.", "کاش بمیری {I}.", "فکرهای تو آشغال است."),
        "hateful": ("{G} را به دریا بریزید.", "زندگی بدون {G} بهتر است.", "{G} فقط کثافت و بیماری می‌آورند.", "{G} حق ندارند، آنها سوسک هستند.", "از {G} متنفرم، دروغگو و دزد هستند.", "بدون {G} بهتر هستیم، باید اخراج شوند."),
        "sexual": ("برای دیدن دختران لخت کلیک کن.", "لباسش را کند و در تخت سکس کردند.", "فیلم سکسی رایگان برای بزرگسالان.", "رقاصه پستان لختش را به مردان نشان داد."),
    },
}

BENIGN = {
    "en": (
        "The rooster, called a cock on this farm, wakes the other animals.", "Sex chromosomes decide whether an animal is male or female.", "During puberty the breasts grow and the voice changes.", "Rats and lice carried the plague into the city.", "A parasite needs a host, which it does not kill.", "How dumb of me, I left my notes at home.", "I could slap myself for this stupid mistake.", "I was an idiot to skip the second exercise.",
        "In that century {G} were locked up, and the text asks why this was unjust.", "The old law said that {G} should not vote; the lesson explains why it was wrong.", "The museum shows a poster that called {G} a plague, and explains how such hatred grew.", "{G} were given the right to vote in that year.", "The chapter is about how {G} worked and lived.", "Beat the eggs, break the shell and throw it away.", "Antibodies kill the germs, and the cells of the host stay alive.",
        "The breast muscles move the wing of the bird.", "A bitch suckles her puppies.", "The naked mole rat lives under the ground and breeds in colonies.", "The penis and the vagina are parts of the body, as the figure shows.", "Never trust a scale that has not been checked.", "Without the clean water no plant could grow better.", "The picture is seen better without any help.", "Nobody believed that the cell could live without it.", "The worker bees drive the drones out of the hive.", "The thief in the story was locked up in the tower.", "Nude mice are used in the laboratory.", "You deserve a better mark for this lesson.", "You and your group should repeat the experiment.", "The host dies if the virus destroys too many cells.", "The king was hanged and his palace burned, the history unit says.", "They meet tonight in the hotel to talk about the exam.", "Watch the video of the lesson and call your teacher.", "The trash is burned far from the town.", "The donkey and the dog appear in a fable.",
        "A killer whale hunts in groups.", "The drum is beaten four times, then the arrow is shot.", "His wife and her husband wrote the story together.", "The pupils hate homework but like the museum.", "Pigs and dogs live on the farm.", "Dirty water spreads the disease.",
    ),
    "de": (
        "Der Hahn und das Schwein leben auf dem Bauernhof.", "Die Geschlechtszellen der Pflanzen enthalten Chromosomen.", "In der Pubertät wachsen die Brüste.", "Ratten und Läuse brachten die Pest in die Stadt.", "Das war ein dummer Fehler von mir.", "Ich Trottel habe mein Heft vergessen.", "Das alte Gesetz verbot {G} zu wählen; die Lektion erklärt, warum das Unrecht war.", "Das Plakat nannte {G} eine Seuche, und der Text erklärt, wie solcher Hass entstand.", "{G} durften in jenem Jahr zum ersten Mal wählen.", "Der Text erzählt, wie {G} lebten und arbeiteten.",
        "Das Virus tötet die Zelle.", "Nacktschnecken und nackte Samen stehen im Kapitel.", "Der Dieb in der Geschichte wurde eingesperrt.", "Ohne sauberes Wasser wächst keine Pflanze besser.", "Man erkennt das Bild besser ohne Hilfe.", "Schau dir heute das Video der Lektion an.", "Die Frau und ihr Mann schliefen im Hotel.", "Die sexuelle Fortpflanzung wird im Kapitel erklärt.", "Der Esel und der Hund kommen in der Fabel vor.",
    ),
    "fr": (
        "Le coq et le cochon vivent à la ferme.", "Les chromosomes sexuels décident du sexe de l'animal.", "À la puberté, les seins grandissent.", "Les rats apportaient la peste dans la ville.", "C'est une erreur stupide de ma part.", "Quel idiot je suis, j'ai oublié mon cahier.", "La loi interdisait à {G} de voter ; la leçon explique pourquoi c'était injuste.", "L'affiche traitait {G} de peste et le texte explique comment cette haine est née.", "{G} ont obtenu le droit de vote cette année-là.", "Le chapitre raconte la vie de {G}.",
        "Le virus tue la cellule.", "La graine nue se trouve chez le pin.", "Le voleur de l'histoire fut enfermé.", "Sans eau propre aucune plante ne pousse mieux.", "On comprend mieux le dessin sans aide.", "Regarde ce soir la vidéo de la leçon.", "La femme et son mari dormaient à l'hôtel.", "L'âne et le chien sont dans la fable.", "La reproduction sexuelle des plantes est expliquée.",
    ),
    "es": (
        "El gallo y el cerdo viven en la granja.", "Los cromosomas sexuales deciden el sexo del animal.", "En la pubertad crecen los pechos.", "Las ratas llevaban la peste a la ciudad.", "Fue un error estúpido mío.", "Qué idiota soy, olvidé mi cuaderno.", "La ley prohibía votar a {G}; la lección explica por qué era injusto.", "El cartel llamaba peste a {G} y el texto explica cómo nació ese odio.", "{G} obtuvieron el derecho a votar ese año.", "El capítulo cuenta la vida de {G}.",
        "El virus mata la célula.", "La semilla desnuda se halla en el pino.", "El ladrón de la historia fue encerrado.", "Sin agua limpia ninguna planta crece mejor.", "Se entiende mejor el dibujo sin ayuda.", "Mira esta noche el vídeo de la lección.", "La mujer y su esposo dormían en el hotel.", "El burro y el perro están en la fábula.", "La reproducción sexual de las plantas se explica.",
    ),
    "pt": ("O galo e o porco vivem na quinta.", "Os cromossomas sexuais decidem o sexo do animal.", "Foi um erro estúpido meu.", "Que idiota sou, esqueci o caderno.", "A lei proibia {G} de votar; a lição explica por que era injusto.", "O cartaz chamava peste a {G} e o texto explica como nasceu esse ódio.", "O vírus mata a célula.", "Percebe-se melhor o desenho sem ajuda.", "A semente nua acha-se no pinheiro.", "O burro e o cão estão na fábula.", "{G} puderam votar nesse ano."),
    "ar": (
        "يعيش الديك والحمار والكلب في المزرعة.", "تحدد الكروموسومات الجنسية جنس الحيوان.", "حملت الجرذان الطاعون إلى المدينة.", "كان خطأ غبيًا مني.", "كم أنا أحمق فقد نسيت دفتري.", "كان القانون يمنع {G} من التصويت ويشرح الدرس لماذا كان ذلك ظلمًا.", "سمى الملصق {G} وباء ويشرح النص كيف نشأت تلك الكراهية.", "حصل {G} على حق التصويت في ذلك العام.", "يحكي الفصل كيف عاش {G}.", "يقتل الفيروس الخلية.", "البذور العارية موجودة في الصنوبر.", "سُجن اللص في القصة.", "لا ينمو النبات أفضل بدون ماء.", "نفهم الرسم أفضل بدون مساعدة.", "شاهد الليلة فيديو الدرس.",
        "نامت الزوجة وزوجها في الفندق.", "يشرح الفصل التكاثر الجنسي في النبات.", "الطفيليات والحشرات تعيش في جسم الحيوان.", "الماء القذر يسبب المرض.",
    ),
    "fa": ("خروس و الاغ و سگ در مزرعه زندگی می‌کنند.", "کروموسوم‌های جنسی جنس حیوان را تعیین می‌کنند.", "اشتباه احمقانه‌ای از من بود.", "چه احمقی هستم که دفترم را فراموش کردم.", "قانون به {G} حق رای نمی‌داد و درس توضیح می‌دهد چرا نادرست بود.", "پوستر {G} را بیماری نامید و متن توضیح می‌دهد.", "ویروس سلول را می‌کشد.", "دانه لخت در کاج است."),
}
