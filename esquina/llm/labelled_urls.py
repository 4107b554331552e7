"""Hosts and paths labelled by hand: what a URL filter blocks and what it allows. Fixed values."""

BLOCKED = [
    "casino-win.test/slots", "free-bets.test/bonus", "cheap-pills.test/order", "spam-farm.test/links", "adult-zone.test/videos",
    "ads-track.test/click", "onlinecasino.test/play/slots", "pokerbonus.test/free", "best-casino-bonus.test/win", "sportsbet.test/odds",
    "freebets.test/sign", "bet-now.test/odds", "viagra-pills.test/cheap", "cheapmeds.test/buy/pills", "buypills.test/discount",
    "pharmacy-discount.test/pills", "replica-watches.test/cheap", "payday-loans.test/fast", "quickloans.test/apply", "linkfarm.test/links",
    "spamlinks.test/seo", "link-spam.test/farm", "adult-videos.test/xxx", "xxxvideos.test/adult", "hotsex.test/cams", "live-cams.test/adult",
    "porn-videos.test/free", "escort-girls.test/adult", "adserver.test/banner", "ad-track.test/pixel", "clicktrack.test/ads", "popads.test/click",
    "trackads.test/banner", "win-prize.test/claim", "free-prize.test/winner", "lottery-win.test/jackpot", "jackpotslots.test/casino",
    "blog.spam-links.test/en", "www.casino-bonus.test/de", "m.adult-cams.test/fr", "pages.cheap-watches.test/es",
    "crackedkeys.test/warez", "warez-crack.test/serial", "miracle-diet.test/pills",
]

ALLOWED = [
    "daily-news.test/world", "city-library.test/books", "university.test/research", "history-blog.test/articles", "science-today.test/article",
    "weather.test/forecast", "recipes.test/bread", "football-club.test/team", "travel-guide.test/city", "museum.test/art", "music-school.test/lessons",
    "health-service.test/advice", "law-review.test/court", "garden-tips.test/plants", "openmaps.test/street", "localnews.test/town",
    "film-review.test/cinema", "software-docs.test/manual", "codehelp.test/questions", "photo-journal.test/nature", "bookreview.test/novel",
    "mathforum.test/proof", "bird-watching.test/species", "schoolpages.test/class", "community-centre.test/events", "railways.test/timetable",
    "housing.test/rent", "economy-report.test/markets", "parliament.test/debate", "language-course.test/grammar", "chess-club.test/games",
    "hospital.test/patients", "farmers-market.test/food", "free-software.test/download", "opera-house.test/tickets", "marathon.test/running",
    "blog.town-hall.test/en", "www.old-bridge.test/de", "m.river-boats.test/fr", "pages.wild-flowers.test/es",
]
