"""Word lists and dictionaries of the text checks. All are defaults of parameters."""

# Words that begin with a capital without being a name.
STOP_RU = """я он она оно они мы вы ты это этот эта как так что чтобы кто все всё весь вся но ну да нет не ни уже ещё еще только
там тут здесь теперь потом тогда когда если может можно нужно надо хочу буду будет быть господин госпожа товарищ сэр мастер учитель
наставник старейшина капитан командир принц принцесса король королева император лорд леди барон январь февраль март апрель май июнь
июль август сентябрь октябрь ноябрь декабрь понедельник вторник среда четверг пятница суббота прим внимание итог итоги заметка
главное вопрос ответ пример часть глава раздел день ночь утро вечер год месяц неделя""".split()
STOP_EN = """i he she it they we you this that these those how what who why where when all but yes no not yet still just only there
here then now later soon maybe perhaps can could should would will shall must and or so if because as once everything nothing
something everyone nobody somebody anyone did does done get got have has had was were been being mister mistress sir madam master
teacher mentor elder captain commander prince princess king queen emperor lord lady baron general doctor doc professor colonel
sergeant lieutenant officer sheriff mrs miss january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday note notes warning summary answer example part chapter section day night
morning evening year month week""".split()

# Words whose repetition is no matter of style.
FUNCTION_RU = """который которая которое которые которого которой которым которую которых которыми этот эта это эти этого этой этих
этим этими такой такая такое такие такого весь вся все всего всей всех всем всеми себя себе собой когда если чтобы потому поэтому
затем тогда тоже также причем хотя ведь либо быть был была было были будет будут буду есть моей мой моя твой твоя наш наша ваш ваша
ихний него нее ней ними им их ему тут там здесь здеся при под над про без тем том так сей оба обе три два сто""".split()
FUNCTION_EN = """which that this these those whose when if because so then also too though although while was were been being are have
has had will would can could should shall may might must does did the and but not nor for with from him her his hers its our ours
their theirs them they she you your yours who whom what where there here both two three one ten hundred unto""".split()

# Words that alone make no turn of phrase.
ECHO_RU = """в во не ни на по с со из изо у за до от об о обо про через сквозь над под перед между и а но да или либо же бы б ли то это
этот эта эти тот та те там тут здесь когда если чтобы потому поэтому зато впрочем однако ведь вот вон даже уже еще только потом тогда
как что кто все весь вся свой своя мое моя мой твой твоя наш ваш себя куда откуда зачем можно нельзя нужно надо пусть почти был была
было были будет будут быть есть нет""".split()
ECHO_EN = """the a an and or but if then else when while because so that this these those there here it its he she they we you i me him
her them us my your his their our what who whom which how why where as at by for with from to of in on off out up down over under
again further once all any both each few more most other some such no not nor only own same too very can will just should now was
were is are be been being have has had do does did would could shall may might must o u im ive dont cant wont s t d ll re ve""".split()

# Filler words and intensifiers.
FILLERS_RU = ["просто", "очень", "конечно", "в общем", "как бы", "собственно", "на самом деле", "в принципе", "короче", "типа", "как будто", "именно", "даже", "вот", "уже", "еще", "только", "потом", "итак"]
FILLERS_EN = ["just", "very", "really", "quite", "rather", "somewhat", "actually", "basically", "literally", "totally", "definitely", "obviously", "simply", "suddenly", "somehow", "kind of", "sort of", "of course", "in fact"]

# Folders and files that a walk over a vault leaves out.
SERVICE_FOLDERS = [".obsidian", ".git", ".trash", ".smart-env", "md_replace_backups"]
TEXT_EXTENSIONS = ["md", "txt", "docx", "html", "htm"]

# Short words that keep the next word on their line.
NBSP_WORDS = ["в", "и", "с", "к", "о", "у", "а", "но", "не", "ни", "на", "по", "за", "из", "от", "до", "об", "для", "при", "над", "под", "как", "что", "же", "ли", "бы", "б"]


def stop_words(lang: str | None) -> list[str]:
    """Stop words of names; only ``en`` uses its list alone."""
    return STOP_EN if lang == "en" else sorted({*STOP_RU, *STOP_EN})


def style_stop_words(lang: str | None) -> list[str]:
    return sorted({*STOP_EN, *FUNCTION_EN}) if lang == "en" else sorted({*STOP_RU, *STOP_EN, *FUNCTION_RU})
