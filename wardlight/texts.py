"""Explanation texts shown to people (fixed values): key -> Uzbek, English, Russian. {…} is filled per message."""

REASONS = {
    "secret_code": (
        "SMS kod, karta raqami yoki CVV so'ralmoqda — hech qachon hech kimga bermang",
        "Asks for an SMS code, card number or CVV — never share these",
        "Просят SMS-код, номер карты или CVV — никогда никому их не сообщайте"),
    "prize": (
        "Kutilmagan yutuq yoki sovg'a va'da qilinmoqda",
        "Promises an unexpected prize or gift",
        "Обещают неожиданный выигрыш или подарок"),
    "urgency": (
        "Shoshiltirish va vaqt bosimi — firibgarlarning asosiy usuli",
        "Pressure to act fast — a classic scam tactic",
        "Давят срочностью — классический приём мошенников"),
    "blocked_account": (
        "Kartangiz yoki hisobingiz bloklangani haqida qo'rqitish",
        "Scares you that your card or account is blocked",
        "Пугают блокировкой карты или счёта"),
    "bank_impersonation": (
        "O'zini bank xodimi yoki xavfsizlik xizmati deb tanishtirmoqda — banklar kod so'ramaydi",
        "Claims to be bank security staff — real banks never ask for codes",
        "Представляются сотрудником банка — настоящие банки никогда не спрашивают коды"),
    "advance_fee": (
        "Pul olish uchun avval pul to'lash talab qilinmoqda",
        "Asks you to pay first in order to receive money",
        "Требуют сначала заплатить, чтобы получить деньги"),
    "marketplace": (
        "OLX/savdo firibgarligi belgisi: 'to'lovni havola orqali qabul qiling'",
        "Marketplace scam pattern: 'receive payment through this link'",
        "Схема мошенничества на OLX: «получите оплату по ссылке»"),
    "easy_money": (
        "Oson va tez daromad va'dasi",
        "Promises easy, fast money",
        "Обещают лёгкие и быстрые деньги"),
    "apk_file": (
        ".apk fayl — bu rasm yoki hujjat emas, telefonga o'rnatiladigan dastur. Ochmang!",
        "An .apk file is an installable Android app, not a photo or document. Don't open it!",
        "Файл .apk — это не фото и не документ, а устанавливаемое приложение. Не открывайте!"),
    "install_app": (
        "Fayl yoki ilova o'rnatishga undamoqda — .apk orqali telefoningiz o'g'irlanishi mumkin",
        "Pushes you to install a file or app — .apk files can hijack your phone",
        "Уговаривают установить файл или приложение — через .apk могут взломать телефон"),
    "relative_in_trouble": (
        "Qarindosh nomidan pul so'rash — avval o'sha odamga eski raqamiga qo'ng'iroq qiling",
        "Someone posing as a relative asking for money — call them on their old number",
        "Просят деньги от имени родственника — позвоните ему на старый номер"),
    "threat_payment": (
        "Tahdid va pul talabi («to'lamasangiz — sud/arest»). Davlat idoralari messenjer orqali bunday talab qilmaydi",
        "Threatens you and demands payment (\"pay or face court/arrest\"). Real authorities don't do this via messengers",
        "Угрожают и требуют оплату («заплатите, иначе суд/арест»). Госорганы так не делают через мессенджеры"),
    "fake_admission": (
        "Pul evaziga o'qishga kirish yoki grantni «kafolatlash». Haqiqiy tanlovlarda bunday bo'lmaydi",
        "Promises guaranteed admission or a grant for money. Real selection processes never work like this",
        "Обещают «гарантированное» поступление или грант за деньги. Так не бывает в настоящих конкурсах"),
    "gov_impersonation": (
        "Davlat idorasi, kompensatsiya yoki jarima nomidan murojaat",
        "Uses a government body, compensation or fine as bait",
        "Прикрываются госорганом, компенсацией или штрафом"),
    "lookalike_site": (
        "«{host}» — {brand} saytiga o'xshatib yasalgan soxta sayt (asl manzil: {real})",
        "'{host}' imitates {brand} (the real domain is {real})",
        "«{host}» подделка под {brand} (настоящий сайт: {real})"),
    "punycode": (
        "Domen punycode (xn--) bilan yozilgan — harflar almashtirilgan bo'lishi mumkin",
        "Punycode (xn--) domain: letters may be swapped for lookalikes",
        "Домен в punycode (xn--): буквы могут быть подменены похожими"),
    "ip_link": (
        "Havola domen emas, to'g'ridan-to'g'ri IP manzilga olib boradi",
        "Link points to a raw IP address instead of a domain",
        "Ссылка ведёт на IP-адрес вместо обычного домена"),
    "shortener": (
        "Qisqartirilgan havola ({host}) — asl manzil yashirilgan",
        "Shortened link ({host}) hides the real destination",
        "Сокращённая ссылка ({host}) скрывает настоящий адрес"),
    "risky_tld": (
        ".{tld} domen zonasi firibgarlikda ko'p ishlatiladi",
        "The .{tld} domain zone is common in scams",
        "Доменная зона .{tld} часто используется мошенниками"),
    "subdomains": (
        "Domen juda ko'p qismdan iborat (subdomenlar zanjiri)",
        "Unusually long chain of subdomains",
        "Подозрительно длинная цепочка поддоменов"),
    "at_trick": (
        "Havolada '@' belgisi bor — haqiqiy manzil yashirilgan",
        "'@' in the link hides the real destination",
        "Символ «@» в ссылке скрывает настоящий адрес"),
    "apk_link": (
        "Havola .apk faylga olib boradi — telefoningizga zararli ilova o'rnatilishi mumkin",
        "Link downloads an .apk file that may install malware",
        "Ссылка скачивает .apk-файл, который может установить вирус"),
    "bait_domain": (
        "Domen nomida 'bonus/karta/to'lov/verify' kabi so'zlar bor",
        "Domain name contains bait words like bonus/card/pay/verify",
        "В названии домена слова-приманки: bonus/card/pay/verify"),
    "http": (
        "Himoyalanmagan (http) ulanish",
        "Unencrypted (http) connection",
        "Незащищённое (http) соединение"),
    "ai_model": (
        "AI model matnni {pct}% ehtimol bilan firibgarlik deb baholadi",
        "The AI model rates this text {pct}% likely to be a scam",
        "AI-модель оценивает вероятность мошенничества в {pct}%"),
    "needs_context": (
        "Xabar pul so'rayapti, lekin firibgarlik belgisi aniq emas. Buni kutganmidingiz? Qabul qiluvchini o'zingiz "
        "tekshiring: tanish bo'lsa — o'zingiz qo'ng'iroq qiling, do'kon bo'lsa — rasmiy sayt yoki ilova orqali. "
        "Tekshirmaguncha pul o'tkazmang.",
        "This message asks for money, but there's no clear sign of fraud. Were you expecting it? Check the recipient "
        "yourself: call the person you know, or use the shop's official site or app. Don't send money until you have.",
        "Сообщение просит деньги, но явных признаков мошенничества нет. Вы этого ждали? Проверьте получателя сами: "
        "позвоните знакомому, у магазина — через официальный сайт или приложение. Не переводите деньги, пока не "
        "проверите."),
    "asked": (
        "Xabar sizdan buni talab qilyapti: «{evidence}»",
        "The message asks you to do this: «{evidence}»",
        "Сообщение просит вас сделать это: «{evidence}»"),
    "official_sites": (
        "Havola rasmiy saytga olib boradi: {sites}",
        "The link goes to an official site: {sites}",
        "Ссылка ведёт на официальный сайт: {sites}"),
    "is_warning": (
        "Bu ogohlantirish — xabar sizdan hech narsa so'ramayapti: «{evidence}»",
        "This is a warning — the message doesn't ask you for anything: «{evidence}»",
        "Это предупреждение — сообщение ничего у вас не просит: «{evidence}»"),
    "is_story": (
        "Bu bo'lib o'tgan voqea haqida hikoya — xabar sizdan hech narsa so'ramayapti: «{evidence}»",
        "This describes something that already happened — it doesn't ask you for anything: «{evidence}»",
        "Это рассказ о случившемся — сообщение ничего у вас не просит: «{evidence}»"),
}
# What evidence from outside the text says: the crowd, an attached file, what an app may do, looked-up answers.
EVIDENCE = {
    "community": (
        "Bir necha kishi shu havola, raqam, akkaunt yoki shunga o'xshash xabar ustidan shikoyat qilgan",
        "Several people have reported this link, number, account or a message like it",
        "Несколько человек пожаловались на эту ссылку, номер, аккаунт или похожее сообщение"),
    "file_program": (
        "Biriktirilgan fayl — dastur: notanish odamdan kelgan bo'lsa, ochmang",
        "The attached file is a program: do not open it if it comes from a stranger",
        "Вложенный файл — программа: не открывайте, если его прислал незнакомец"),
    "apk_reads_sms": ("Ilova SMS xabarlarni o'qiydi, bank kodlarini ham", "The app reads text messages, bank codes among them", "Приложение читает SMS, в том числе коды банка"),
    "apk_accessibility": ("Ilova ekranni ko'radi va siz uchun bosadi", "The app sees the screen and can tap for you", "Приложение видит экран и может нажимать за вас"),
    "apk_notifications": ("Ilova barcha bildirishnomalarni o'qiydi", "The app reads all notifications", "Приложение читает все уведомления"),
    "apk_overlay": ("Ilova boshqa ilovalar ustida oyna ochadi", "The app shows windows over other apps", "Приложение показывает окна поверх других"),
    "apk_device_admin": ("Ilova qurilma administratori bo'lmoqchi", "The app wants to administer the device", "Приложение хочет управлять устройством"),
    "apk_sends_sms": ("Ilova sizning nomingizdan SMS yuboradi", "The app sends text messages in your name", "Приложение отправляет SMS от вашего имени"),
    "apk_calls": ("Ilova qo'ng'iroqlarni boshqaradi", "The app controls phone calls", "Приложение управляет звонками"),
    "apk_installs_apps": ("Ilova boshqa ilovalarni o'rnatadi", "The app installs other apps", "Приложение устанавливает другие приложения"),
    "apk_contacts": ("Ilova kontaktlarni o'qiydi", "The app reads the contacts", "Приложение читает контакты"),
    "apk_sees_apps": ("Ilova o'rnatilgan bank ilovalarini ko'radi", "The app sees which bank apps are installed", "Приложение видит, какие банковские приложения установлены"),
    "apk_hidden_icon": ("Ilova bosh ekranda ko'rinmaydi", "The app does not show on the home screen", "Приложения не видно на главном экране"),
    "apk_evasion": ("Fayl tekshirib bo'lmasligi uchun buzilgan", "The file is damaged so that it cannot be examined", "Файл испорчен так, чтобы его нельзя было проверить"),
}
#: Signals of online lookups share one text.
LOOKED_UP = (
    "Onlayn tekshiruv bu sayt yoki havolani xavfli deb topdi",
    "An online check found this site or link to be dangerous",
    "Онлайн-проверка считает этот сайт или ссылку опасной")
LANGUAGES = ("uz", "en", "ru")
