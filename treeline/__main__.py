from .phases import main

main()
