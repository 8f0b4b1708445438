"""Texts that appear in results."""

# The labels and descriptions the results carry.
STANDARDIZE = "стандартизировать"
NORMALIZE = "нормализовать"
HAS_OUTLIERS = "наличие выбросов"
ASYMMETRIC = "асимметричное распределение"
HIGH_VARIATION = "высокая вариативность"
STRONG_SKEW = "сильная скошенность"
EVEN = "равномерное распределение без выбросов"

# Fixed values.
ACTION_LABELS = {
    "remove_html": "Удалить HTML-теги",
    "remove_special_chars": "Удалить спецсимволы",
    "handle_numbers": "Обработать числа",
    "word_tokenize": "Токенизировать по словам",
    "sentence_tokenize": "Токенизировать по предложениям",
    "remove_stopwords": "Удалить стоп-слова",
    "consider_remove_stopwords": "Рассмотреть удаление стоп-слов",
    "lemmatize": "Применить лемматизацию",
    "lemmatize_or_stem": "Применить лемматизацию или стемминг",
    "stem": "Применить стемминг",
}

# Fixed values.
CLEANING = {
    "remove_html": "Текст содержит HTML-теги. Рекомендуется удаление",
    "remove_special_chars": "Текст содержит спецсимволы. Рекомендуется удаление",
    "handle_numbers": "Текст содержит цифры. Рекомендуется выбрать стратегию обработки",
}

# Fixed values.
TASK_RULES = {
    "spelling": ("word_tokenize", "Точное исправление ошибок требует разбивки по словам"),
    "sentiment": ("sentence_tokenize", "Контекст предложения важен для тональности"),
    "ner": ("word_tokenize", "Распознавание сущностей требует анализа слов"),
    "summarization": ("sentence_tokenize", "Сохранение структуры предложений"),
    "clustering": ("word_tokenize", "Тематический анализ требует анализа слов"),
    "translation": ("sentence_tokenize", "Контекст предложения важен для перевода"),
    "question_answering": ("sentence_tokenize", "Анализ вопроса и контекста"),
}

SHORT_TEXT = "Короткий текст: разбивка по словам"
LONG_SENTENCES = "Длинные предложения (>15 слов)"
QUESTIONS = "Наличие вопросов"
STANDARD = "Стандартная рекомендация"
MANY_STOPWORDS = "Высокий процент стоп-слов"
SOME_STOPWORDS = "Умеренный процент стоп-слов"
LEMMA_MUCH_BETTER = "Лемматизация значительно лучше сохраняет смысл"
LEMMA_BETTER = "Лемматизация предпочтительна"
STEM_ENOUGH = "Стемминг достаточен"
