"""Labelled examples of messages that stand where content should: what the classifier of templates is fitted on.

Beside these, the classifier sees a bounded sample of the corpus. The examples are no rules: no text is compared
with them, and a test measures recall on messages whose wording is not among them.
"""

ERROR = """
page not found
the page could not be found
this page was removed or its address has changed
we could not find that page
we can't seem to find what you are looking for
sorry, the page you were looking for does not exist
the product you are looking for is no longer here
the item you requested does not exist
the link is broken or was removed
the link you followed may be broken or expired
no such product
no such item
no such page
not found
url not found on this server
the requested resource could not be found
404 not found
http error 404
error 404 page missing
nothing was found at this location
nothing here
file not found
object not found
resource not found
route not found
record not found
category not found
gone
the requested page is no longer available at this address and there is no forwarding address
bad request
the server could not understand the request
your browser sent an invalid request
invalid request
invalid url
invalid parameter
missing parameter
unauthorized
authorization required
login required
you must be logged in to see this page
please sign in to continue
your session has timed out
your session has ended, sign in again
token has expired
security token mismatch
payment required
forbidden
access denied
access to this page has been denied
access to this resource is forbidden
permission denied
you do not have permission to view this resource
you are not authorized to view this page
you don't have access to this page on this server
your ip address has been banned
your request was blocked
request blocked
blocked by the firewall
blocked by administrator
this request was blocked by the security rules
method not allowed
not acceptable
proxy authentication required
request timed out
request timeout
conflict
length required
precondition failed
payload too large
request entity too large
uri too long
unsupported media type
expectation failed
unprocessable entity
locked
too early
upgrade required
too many requests
too many requests, try again later
you have sent too many requests in a short time
request limit reached
daily quota exceeded
bandwidth limit exceeded
api rate limited
slow down, you are going too fast
request header fields too large
unavailable for legal reasons
internal server error
500 internal error
server error
the server encountered an error and could not complete your request
the server encountered an internal error or misconfiguration
an unexpected error has occurred
an error occurred while processing your request
an error occurred
unknown error
unexpected error, please try again
something went wrong
something went wrong on our side
oops, something went wrong
whoops, looks like something went wrong
uh-oh, something broke
sorry, we had a problem loading this page
sorry, there was a problem
there has been a critical error on this website
there was a problem with the server
not implemented
bad gateway
502 bad gateway
gateway error
the proxy server received an invalid response from an upstream server
upstream connect error or disconnect before headers
service unavailable
service temporarily unavailable
503 service unavailable
the service is not available at the moment
temporarily unavailable, please try again in a few minutes
the server is temporarily unable to service your request
the server is busy
the server is overloaded
server too busy
backend fetch failed
error 503 backend unavailable
guru meditation
gateway timeout
gateway timed out
504 gateway time-out
the server took too long to reply
the server did not respond in time
the server is not responding
the operation timed out
the connection has timed out
the connection was reset
connection refused
connection closed
connection lost
network error
failed to fetch
failed to load
failed to load resource
could not load this page
unable to load page
unable to connect
unable to reach the server
this site can't be reached
this page isn't working
this page can't be displayed
this page cannot be displayed
the web page is not responding
host unknown
domain not found
server not found
name not resolved
err_name_not_resolved
err_connection_refused
err_internet_disconnected
err_empty_response
err_ssl_protocol_error
err_too_many_redirects
net::err_failed
certificate expired
your connection is not private
the certificate is not valid
http version not supported
insufficient storage
loop detected
network authentication required
database error
database connection failed
error establishing a database connection
could not connect to database
mysql server has gone away
sql syntax error
syntax error
unexpected token
unexpected end of input
unexpected end of file
parse error
fatal error
fatal error: uncaught exception
uncaught typeerror: undefined is not a function
cannot read property of undefined
null pointer exception
java.lang.nullpointerexception
traceback (most recent call last)
runtime error
application error
a client-side exception has occurred
server-side exception
unhandled error
exception
segmentation fault
out of memory
memory limit exceeded
maximum execution time exceeded
disk full
cannot post /login
cannot put /cart
template not found
view not found
render error
error page
error report
error code
error
warning: division by zero
warning: undefined variable
deprecated function
core dumped
we are down for maintenance
down for maintenance
under maintenance
the site is under maintenance
scheduled maintenance in progress
the store is closed for maintenance, please come back later
our website is currently offline
the site is currently unavailable
we are upgrading our systems
system upgrade in progress
we will be back soon
thank you for your patience
please bear with us
be back shortly
back online soon
please check back later
please try again later
try again later
website is under construction
this domain is parked
account suspended
this site has been disabled
this website has been suspended
this shop is currently closed
we are experiencing heavy traffic
high demand at the moment, you are in a queue
the system is at its limit
waiting room
see the stack below for debug information
debug mode
call stack
this application could not be started
the application has crashed
process exited with code 1
health check failed
no route to host
lookup failed
handshake failed
invalid token
invalid credentials
csrf verification failed
policy violation
consult your network administrator
the url you entered was refused
your account is locked
your account has been disabled
default web site page
it works!
welcome to nginx
apache is functioning normally
index of /
iis windows server
page introuvable
la page que vous cherchez n'existe plus
erreur interne du serveur
accès refusé
service indisponible
une erreur est survenue
cette page n'existe pas
le serveur ne répond pas
veuillez réessayer plus tard
session expirée
requête invalide
délai dépassé
seite nicht gefunden
interner serverfehler
dienst nicht verfügbar
die angeforderte seite existiert nicht
ein fehler ist aufgetreten
der zugriff ist gesperrt
bitte versuchen sie es später erneut
verbindung fehlgeschlagen
die sitzung ist abgelaufen
der zugriff auf diese seite ist nicht erlaubt
página no encontrada
error interno del servidor
acceso denegado
servicio no disponible
la página que busca no existe
se ha producido un error
el servidor no responde
inténtelo de nuevo más tarde
pagina non trovata
il sito non è raggiungibile
errore interno del server
accesso negato
servizio non disponibile
la pagina richiesta non esiste
si è verificato un errore
riprova più tardi
página não encontrada
erro interno do servidor
acesso negado
serviço indisponível
ocorreu um erro
pagina niet gevonden
de pagina kon niet worden gevonden
de server reageert niet
dit bestand bestaat niet
interne serverfout
toegang geweigerd
er is een fout opgetreden
probeer het later opnieuw
strona nie została znaleziona
wystąpił błąd
sayfa bulunamadı
bir hata oluştu
halaman tidak ditemukan
terjadi kesalahan
sidan hittades inte
siden blev ikke fundet
sivua ei löytynyt
stránka nenalezena
страница не найдена
произошла ошибка
доступ запрещен
ошибка сервера
ページが見つかりません
エラーが発生しました
页面不存在
找不到网页
服务器错误
访问被拒绝
페이지를 찾을 수 없습니다
오류가 발생했습니다
الصفحة غير موجودة
حدث خطأ
पृष्ठ नहीं मिला
පිටුව හමු නොවීය
සේවාදායක දෝෂයකි
දෝෂයක් සිදු විය
ප්‍රවේශය ප්‍රතික්ෂේප විය
பக்கம் கிடைக்கவில்லை
சேவையக பிழை
பிழை ஏற்பட்டது
அணுகல் மறுக்கப்பட்டது
"""

NOTICE = """
please enable javascript
please enable javascript to view this page
please enable js and cookies to continue
enable javascript and cookies to continue
enable scripts to see prices
you need to enable javascript to run this app
you must allow scripts in your browser
kindly turn on javascript
turn on scripting and reload
turn on script support so that this app can run
switch on javascript in your browser settings
activate javascript to continue
activate browser scripting in order to see prices
allow browser scripts before the shop can be shown
javascript is required
javascript is disabled in your browser
javascript is turned off
javascript must be enabled
javascript required to view this site
this site requires javascript
this site needs javascript and cookies
this shop needs scripts
this app works best with javascript enabled
we require javascript and cookies
we require scripts
noscript
noscript: scripts are off in this browser
your browser does not support javascript
your browser has disabled scripts
your browser has disabled script support
your browser is out of date
your browser is not supported, please upgrade
cookies are disabled
cookies are required
please enable cookies
scripts are disabled
scripts are required to load this page
sorry, this page needs scripting
loading, please wait while scripts load
just a moment
just a moment, please wait
please wait while we check your browser
please wait
one moment please
checking your browser
checking your browser before access
checking if the site connection is secure
checking you are not a robot
verify you are human
verifying you are human
please verify that you are human
prove that you are human
confirm you are a human
human verification required
are you a robot?
i am not a robot
robot check
bot check
bot detected
unusual traffic detected from your network
automated access detected
we have detected automated requests
suspicious activity detected
attention required
attention required! security check
one more step
one last step before you continue
complete the captcha
slide to verify
tick the box to show that you are not a robot
click the button below to continue
we think you are a bot
ad blocker detected
ad block is active, please allow this site
allow pop-ups and scripts for this page
complete the security check to access this site
complete the challenge to continue
please solve the captcha to proceed
captcha required
enter the characters you see in the picture
security verification
security challenge
ddos protection
performance and security by the edge network
this check is automatic, your browser will redirect shortly
needs to review the security of your connection before proceeding
redirecting
you will be redirected in a few seconds
javascript est requis pour afficher cette page
activez javascript et les cookies
javascript est désactivé dans votre navigateur
votre navigateur ne prend pas en charge les scripts
veuillez patienter
vérifiez que vous êtes humain
javascript ist deaktiviert
schalten sie javascript ein
ihr browser unterstützt keine skripte
bitte warten
bestätigen sie, dass sie ein mensch sind
javascript está desactivado en su navegador
active javascript para continuar
debe habilitar las cookies
por favor espere
verifique que es humano
attiva javascript per continuare
javascript è disattivato nel browser
abilitare i cookie
attendere prego
ative o javascript para continuar
o javascript está desativado
schakel javascript in om verder te gaan
javascript is vereist
włącz javascript
lütfen javascript'i etkinleştirin
aktifkan javascript
slå på javascript
включите javascript
подождите, идет проверка браузера
javascriptを有効にしてください
请启用javascript
자바스크립트를 활성화하세요
يرجى تفعيل جافا سكريبت
කරුණාකර javascript සක්‍රීය කරන්න
தயவுசெய்து javascript இயக்கவும்
"""

FILLER = """
lorem ipsum
lorem ipsum dolor sit amet
lorem ipsum dolor sit amet consectetur adipiscing elit
sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat
duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur
excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum
sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium
totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo
nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit
sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt
neque porro quisquam est qui dolorem ipsum quia dolor sit amet consectetur adipisci velit
sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem
quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur
at vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti
quos dolores et quas molestias excepturi sint occaecati cupiditate non provident similique sunt in culpa
nam libero tempore cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus
temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet
itaque earum rerum hic tenetur a sapiente delectus ut aut reiciendis voluptatibus maiores alias consequatur
praesent commodo cursus magna vel scelerisque nisl consectetur et
vivamus sagittis lacus vel augue laoreet rutrum
cras mattis consectetur purus sit amet fermentum
nullam quis risus eget urna mollis ornare vel eu leo
aenean lacinia bibendum nulla sed consectetur
vestibulum id ligula porta felis euismod semper
integer posuere erat a ante venenatis dapibus posuere
pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas
curabitur blandit tempus porttitor
etiam porta sem malesuada magna mollis euismod
fusce dapibus tellus ac cursus commodo tortor mauris condimentum nibh
suspendisse potenti phasellus eu sem in mi pharetra convallis
proin sed sapien et augue elementum gravida
nunc viverra imperdiet enim fusce est
vestibulum ante ipsum primis in orci luctus et ultrices posuere cubilia curae
class aptent taciti sociosqu ad litora torquent per conubia nostra per inceptos himenaeos
morbi leo risus porta ac consectetur ac vestibulum at eros
donec sed odio dui nulla vitae elit libero a pharetra augue
nulla facilisi ut fringilla suspendisse potenti nunc feugiat mi a tellus consequat imperdiet
in hac habitasse platea dictumst vivamus adipiscing fermentum quam volutpat aliquam
lorem dolor sit
ipsum nisi amet
sit amet
placeholder
placeholder text
placeholder title
placeholder for the product name
dummy text
dummy product
dummy item
demo product
demo item do not buy
demo listing
example item
example heading
example product name
sample product
sample page
sample description
sample listing 3
test
test product
test item
test page
test listing please ignore
testing testing
test test test
untitled
untitled document
untitled product
untitled page
new page
new document
new product
new product (copy 2)
new item
copy of product
item copy 4
product name
product name 1
product title
product title goes here
product description goes here
product description
page title
page title here
description
title
heading
subheading
heading 1
title goes here
text goes here
description goes here
name goes here
content goes here
your text here
your headline here
your headline goes here
your message here
your logo here
your company name
your description here
your title here
type your text here
type here
click to edit
click here to edit this text
click to add title
double click to edit
insert text
insert title here
insert description
insert description here
insert product name
insert image here
add a description
add title here
add text here
add headline
enter text
enter title
enter your description
enter product name here
enter name
write your text here
write your description here
write title
fill in the title
fill in later
todo
todo: add title
todo write title
todo: write description
todo add text
fixme
xxx
xxxx xxxx xxxx
xxxxx
aaa
asdf
asdf asdf
qwerty
qwerty qwerty
foo
foo bar
foo bar baz
foo foo foo
bar bar
blah blah blah
bla bla bla
hello world
abc abc
zzz zzz
n/a
tbd
tba
tbc
tbc - copy to follow
tba - text to follow
copy to follow
copy to be confirmed
title to follow
text to come
description to be added
details to be confirmed
content to be added later
to be announced
to be completed
coming soon text
coming soon
content coming soon
text coming soon
more text here
some text here
some description
body text
first paragraph here
a paragraph of stand-in words
body copy
this is a sample
this is a test
this is a placeholder
this is some dummy content
this text is a placeholder and should be replaced
replace this text
replace me
change this text
replace with real content
put your own text in here
your own content here
tell visitors about this product
say something about your shop
description pending
text to be provided
draft text
edit this text
edit me
do not publish
draft - do not publish
texte ici
votre texte ici
titre du produit
insérer le texte
texte de remplacement
ihr text hier
beispieltext
blindtext
platzhalter
titel eingeben
texto de ejemplo
su texto aquí
título del producto
escriba aquí
testo di esempio
il tuo testo qui
inserisci testo
texto de exemplo
seu texto aqui
voorbeeldtekst
uw tekst hier
przykładowy tekst
örnek metin
contoh teks
пример текста
ваш текст здесь
サンプルテキスト
示例文本
여기에 텍스트 입력
මෙහි පෙළ ඇතුළත් කරන්න
உரையை இங்கே உள்ளிடவும்
"""

AROUND = """
oops
whoops
uh-oh
sorry
we are sorry
sorry about that
sorry for the inconvenience
we apologise for the inconvenience
warning
exception
error
error 404
http error 500
fatal error
status code 503
code 500
reference number 12
request id 52644
request id
ray id 6cbd143
ray 6cbd143
trace id
incident id
error id
event id
contact the desk
contact the galle desk
contact us
contact support
contact the site owner
contact the administrator
please contact the webmaster
report this problem
go back
go back to the home page
back to home
back to the previous page
return to the home page
return to shop
take me home
home page
try searching
try a search
try searching our site
search our site
use the search box
please reload
reload the page
refresh the page
refresh and try again
retry
try again
click here to retry
please check the address
check the spelling of the address
check your internet connection
if the problem persists contact support
your ip
cloudflare
nginx
apache server at port 80
powered by
loading
"""

CONTENT = """
404 coffee mug
404 error hoodie black
error 404 graphic t-shirt
access control keypad for doors
access denied door sign
server rack cabinet 42u with fan
home server with two bays
gateway router dual band
wireless gateway for sensors
browser game gift card
browser's guide to antique shops
javascript pocket guide
learning javascript, third edition
the cookie jar with lid
cookie cutter set of 6
robot vacuum cleaner with dock
robot toy for children
captcha board game
forbidden island board game
forbidden city poster
service unavailable badge
internal hard drive 2 tb
internal battery replacement
exception handling in java, paperback
null modem cable
undefined fragrance 50 ml
nan bread tray
lorem ipsum wall poster
lorem ipsum mug
placeholder card holder
dummy camera for shop windows
dummy phone, display model
test tube rack
pregnancy test kit
blood glucose test strips 50
multimeter test leads
sample pack of screen films
fabric sample book
sample drum pad
title deed folder
page holder for books
blank template stencil
todo list whiteboard
untitled canvas sketchbook
document scanner a4
new balance running shoes
new arrival cotton shirt
brand new sealed phone 8gb 128gb
add-on camera lens
insert tray for drawer
heading tool for saddles
timeout bench for toddlers
connection kit for solar panels
network cable cat6 10 m
network switch 8 port
firewall appliance for small offices
memory card 64gb
security camera with night vision
human anatomy model
mobility scooter charger
enable plus walking frame
script font rubber stamp
handwriting practice script book
maintenance kit for printers
maintenance free car battery
bad cat plush toy
blocked drain cleaner
request stop bell for buses
permission slip pad
proxy server handbook
delivery to the city took 12 days and the adapter arrived clearly stiff
after 82 weeks the latch started peeling
temporarily out of stock
sold out at our branch, notify me when back
sold out
out of stock
this item is currently unavailable
this item is currently unavailable in the city
this product is unavailable at our branch
currently unavailable, order for next week
temporarily out of stock in the city
no longer available in this colour
not available for delivery
notify me when available
pre-order now, ships next month
add to cart
price on request
free delivery over rs 5000
returns accepted within 14 days
one year warranty
if checkout says page not found, refresh once
chat needs scripts to be enabled
cookies and scripts are used for the basket only
the site was slow but the parcel came on time
the app showed an error when i paid, still the phone works
support answered my request within an hour
the courier could not find my address
the charger stopped working after a week, service was quick
warranty claims need the serial number and the receipt
tested at 72 c and 74% humidity
the code sticker uses curly and angle signs
product page
category grid
category page
search page
home page
product_page
out of stock placeholder
out_of_stock_placeholder
bot challenge captcha
bot_challenge_captcha
unknown junk
unknown_junk
new
used
black
internal
refurbished
phones
tablets
laptops and notebooks
smartphone 8gb ram 256gb storage
shop tablets at our store
compare models side by side
choose your colour
"""

EXAMPLES = {"error": ERROR, "notice": NOTICE, "filler": FILLER, "around": AROUND, "content": CONTENT}


def examples() -> list[tuple[str, str]]:
    """(kind, text) of every example."""
    return [(kind, line.strip()) for kind, block in EXAMPLES.items() for line in block.splitlines() if line.strip()]
