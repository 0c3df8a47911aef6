"""Fixed values that results depend on: word lists, weights, patterns, thresholds."""

from __future__ import annotations

# Keywords of each record type with their weights.
RECORD_KEYWORDS = {
    "birth": [
        ("родился", 4), ("родилась", 4), ("род", 3), ("крещён", 3), ("крещена", 3),
        ("крещение", 2), ("рождение", 2), ("рожд", 2), ("сын", 1), ("дочь", 1),
    ],
    "death": [
        ("умер", 4), ("умерла", 4), ("скончался", 3), ("скончалась", 3), ("погребён", 2),
        ("погребена", 2), ("похоронен", 2), ("смерть", 2), ("возраст", 1), ("лет", 1),
    ],
    "marriage": [
        ("венчался", 4), ("венчалась", 4), ("брак", 3), ("бракосочетание", 3), ("жених", 2),
        ("невеста", 2), ("супруг", 2), ("супруга", 2), ("муж", 1), ("жена", 1),
    ],
}

# Abbreviations (without the final dot) and what they stand for, in order of application.
# "у." before a word character, without white space, is a district.
ABBREVIATIONS = [
    ("р", "родился"), ("род", "родился"), ("у", "умер"), ("ум", "умер"), ("к", "крещён"),
    ("крещ", "крещён"), ("венч", "венчался"), ("погр", "погребён"), ("от", "отец"), ("мат", "мать"),
    ("г", "год"), ("губ", "губерния"), ("у", "уезд"), ("вол", "волость"), ("свящ", "священник"),
    ("дьяк", "дьякон"), ("пис", "писарь"),
]

# Recognition errors and their repair, in order of application.
OCR_REPAIRS = [
    ("р[оа]дился", "родился"), ("ум[еэ]р", "умер"), ("крещ[её]н", "крещён"),
    ("венч[ао]лся", "венчался"), ("погр[её]б[её]н", "погребён"),
]
# Letters of the old spelling, lower case only.
OLD_LETTERS = {"ѣ": "е", "і": "и", "ѳ": "ф", "ѵ": "и"}

# Months in the genitive, by number.
MONTHS_GENITIVE = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]
# Old spellings of months; the i of the second one is Latin.
MONTHS_OLD = {"генваря": 1, "маiя": 5}
# Roman numerals that the date pattern knows (XII is not among them).
ROMAN_MONTHS = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI"]

# The spelling dictionary; a word that stands for itself only keeps its case, capitals stand for names.
SPELLING = {
    "января": "январь", "февраля": "февраль", "марта": "март", "апреля": "апрель", "мая": "май", "июня": "июнь", "июля": "июль",
    "августа": "август", "сентября": "сентябрь", "октября": "октябрь", "ноября": "ноябрь", "декабря": "декабрь", "родился": "родился",
    "родилась": "родилась", "умер": "умер", "умерла": "умерла", "скончался": "скончался", "скончалась": "скончалась", "крещён": "крещён",
    "крещена": "крещена", "венчался": "венчался", "венчалась": "венчалась", "погребён": "погребён", "погребена": "погребена",
    "похоронен": "похоронен", "похоронена": "похоронена", "сын": "сын", "дочь": "дочь", "отец": "отец", "мать": "мать", "муж": "муж",
    "жена": "жена", "супруг": "супруг", "супруга": "супруга", "брак": "брак", "бракосочетание": "бракосочетание", "иван": "Иван",
    "анна": "Анна", "мария": "Мария", "пётр": "Пётр", "александр": "Александр", "алексей": "Алексей", "екатерина": "Екатерина",
    "елена": "Елена", "ольга": "Ольга", "татьяна": "Татьяна", "надежда": "Надежда", "николай": "Николай", "михаил": "Михаил",
    "владимир": "Владимир", "дмитрий": "Дмитрий", "сергей": "Сергей", "иванов": "Иванов", "петров": "Петров", "сидоров": "Сидоров",
    "кузнецов": "Кузнецов", "смирнов": "Смирнов", "попов": "Попов", "васильев": "Васильев", "зайцев": "Зайцев", "соколов": "Соколов",
    "михайлов": "Михайлов", "фёдоров": "Фёдоров", "белов": "Белов", "козлов": "Козлов", "новиков": "Новиков", "морозов": "Морозов",
    "волков": "Волков", "родившись": "родился", "от": "отец", "мат": "мать", "петр": "Пётр", "федоров": "Фёдоров",
}

# Punctuation that is stripped from both ends of a word before a lookup.
WORD_EDGES = ".,:;!?\"'()[]{}"

# Name variants in order; the first variant is the canonical form.
NAME_VARIANTS = [
    ("иван", ["Иван", "Иоанн", "Ivan", "Ваня"]),
    ("иоанн", ["Иоанн", "Иван", "Ivan"]),
    ("пётр", ["Пётр", "Петр", "Peter", "Петя"]),
    ("петр", ["Пётр", "Петр", "Peter"]),
    ("александр", ["Александр", "Alexander", "Саша"]),
    ("алексей", ["Алексей", "Alexei", "Лёша"]),
    ("михаил", ["Михаил", "Mikhail", "Миша"]),
    ("николай", ["Николай", "Nikolai", "Коля"]),
    ("владимир", ["Владимир", "Vladimir", "Вова"]),
    ("дмитрий", ["Дмитрий", "Dmitry", "Дима"]),
    ("сергей", ["Сергей", "Sergei", "Серёжа"]),
    ("константин", ["Константин", "Konstantin", "Костя"]),
    ("василий", ["Василий", "Vasily", "Вася"]),
    ("павел", ["Павел", "Pavel", "Паша"]),
    ("степан", ["Степан", "Stepan", "Стёпа"]),
    ("григорий", ["Григорий", "Grigory", "Гриша"]),
    ("фёдор", ["Фёдор", "Федор", "Fedor"]),
    ("яков", ["Яков", "Yakov"]),
    ("евгений", ["Евгений", "Evgeny"]),
    ("семён", ["Семён", "Семен", "Semyon"]),
    ("мария", ["Мария", "Maria", "Mary", "Маша"]),
    ("анна", ["Анна", "Anna", "Anne", "Аня"]),
    ("екатерина", ["Екатерина", "Ekaterina", "Catherine", "Катя"]),
    ("елена", ["Елена", "Elena", "Helen", "Лена"]),
    ("ольга", ["Ольга", "Olga", "Оля"]),
    ("татьяна", ["Татьяна", "Tatiana", "Таня"]),
    ("надежда", ["Надежда", "Nadezhda", "Надя"]),
    ("любовь", ["Любовь", "Lyubov", "Люба"]),
    ("вера", ["Вера", "Vera"]),
    ("настасья", ["Настасья", "Анастасия", "Anastasia"]),
    ("анастасия", ["Анастасия", "Anastasia", "Настя"]),
    ("ирина", ["Ирина", "Irina"]),
    ("александра", ["Александра", "Alexandra", "Саша"]),
    ("софья", ["Софья", "София", "Sofia"]),
    ("иванович", ["Иванович"]),
    ("ивановна", ["Ивановна"]),
    ("петрович", ["Петрович"]),
    ("петровна", ["Петровна"]),
    ("александрович", ["Александрович"]),
    ("александровна", ["Александровна"]),
    ("михайлович", ["Михайлович"]),
    ("михайловна", ["Михайловна"]),
    ("николаевич", ["Николаевич"]),
    ("николаевна", ["Николаевна"]),
    ("иванов", ["Иванов", "Ivanov"]),
    ("петров", ["Петров", "Petrov"]),
    ("сидоров", ["Сидоров", "Sidorov"]),
    ("кузнецов", ["Кузнецов", "Kuznetsov"]),
    ("смирнов", ["Смирнов", "Smirnov"]),
    ("попов", ["Попов", "Popov"]),
    ("васильев", ["Васильев", "Vasiliev"]),
    ("зайцев", ["Зайцев", "Zaitsev"]),
    ("соколов", ["Соколов", "Sokolov"]),
    ("михайлов", ["Михайлов", "Mikhailov"]),
    ("фёдоров", ["Фёдоров", "Федоров", "Fedorov"]),
    ("белов", ["Белов", "Belov"]),
    ("козлов", ["Козлов", "Kozlov"]),
    ("новиков", ["Новиков", "Novikov"]),
    ("морозов", ["Морозов", "Morozov"]),
    ("волков", ["Волков", "Volkov"]),
]

# Church calendar references in order; month and day (Julian), "movable" or "circa".
CALENDAR = [
    ("пасха", "movable"), ("рождество", "12-25"), ("рождество христово", "12-25"), ("крещение", "01-06"),
    ("богоявление", "01-06"), ("сретение", "02-02"), ("благовещение", "03-25"), ("вербное воскресенье", "movable"),
    ("вознесение", "movable"), ("троица", "movable"), ("преображение", "08-06"), ("успение", "08-15"),
    ("рождество богородицы", "09-08"), ("воздвижение", "09-14"), ("покров", "10-01"), ("введение", "11-21"),
    ("михайлов день", "11-08"), ("николин день", "12-06"), ("никола зимний", "12-06"), ("никола вешний", "05-09"),
    ("илин день", "07-20"), ("петров день", "06-29"), ("иванов день", "06-24"),
    ("около", "circa"), ("приблизительно", "circa"), ("примерно", "circa"),
]

# Fields of the records.
NAME_FIELDS = ["child_name", "father_name", "mother_name", "groom_name", "bride_name", "deceased_name"]
DATE_FIELDS = ["birth_date", "death_date", "marriage_date", "burial_date", "baptism_date"]

# Element types of a page, and which of them are read.
ELEMENT_TYPES_READ = ["data_cell", "text_block", "header_row", "record_block"]
# Region types with a preprocessor of their own.
REGION_TYPES = ["printed_text", "handwritten", "table_cell", "data_cell", "text_block", "header_row", "record_block", "stamp", "signature", "marginal_note"]
